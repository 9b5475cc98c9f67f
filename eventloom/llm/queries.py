"""The registered queries of the ten operators: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, maxent_lm, packing, quality_rules, sharding, simhash_dedup, token_store, tool_calls, url_filter
from ..sources.scratch import new_path, prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = token_store.write_store(table(spark, sf_dir, "documents"), new_path(spark, "store"), "word_bpe_49k.json", end_id=1)
    return token_store.read_all(directory).withColumnRenamed("key", "doc_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"), n_shards=40)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", capacity=2048, end_id=0)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.labelled(spark))


#: The tool that a plain chat calls: one reply for a turn's text.
REPLY = {"properties": {"text": {"type": "string", "minLength": 1, "maxLength": 2000}, "turn": {"type": "integer", "minimum": 0}}, "required": ["text", "turn"], "additionalProperties": False}


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.from_turns(table(spark, sf_dir, "conversations"))
    linked = tool_calls.link(calls, results, {"reply": REPLY})
    return linked.select(F.col("conv").alias("conv_id"), "call_id", "tool", "position", "result_position", "status", "place", F.concat_ws("; ", "errors").alias("errors"), "valid", "canonical")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("code")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_token_store, op3_sharding, op4_quality_rules, op5_packing, op6_url_filter, op7_tool_calls, op8_decontamination, op9_simhash_dedup, op10_lm_scoring)}

_OP7 = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, text, conv_id || '/' || turn AS call_id,
    conv_id || '/' || CASE turn // 2 % 4 WHEN 0 THEN turn + 2 WHEN 1 THEN turn + 2 WHEN 3 THEN turn - 6 ELSE CASE WHEN conv_id % 10 = 0 THEN turn - 4 END END AS waits_for
  FROM conversations WHERE role = 'user'
), waits AS (
  SELECT c.conv_id, c.call_id, p.call_id AS other FROM calls c LEFT JOIN calls p ON p.conv_id = c.conv_id AND p.call_id = c.waits_for
), levels AS (
  SELECT conv_id, call_id, 0 AS level FROM waits WHERE other IS NULL
  UNION ALL SELECT w.conv_id, w.call_id, l.level + 1 FROM waits w JOIN levels l ON w.conv_id = l.conv_id AND w.other = l.call_id
), results AS (
  SELECT conv_id, turn, text, conv_id || '/' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant'
), met AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id,
    CASE WHEN c.call_id IS NOT NULL THEN 'reply' END AS tool, c.turn AS position, r.turn AS result_position,
    CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN l.level IS NULL THEN 'cyclic' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
    c.text AS asked, r.text AS answered, c.call_id IS NOT NULL AS is_call, l.level, l.level IS NOT NULL AS is_placed
  FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id LEFT JOIN levels l ON l.conv_id = c.conv_id AND l.call_id = c.call_id
)
SELECT conv_id, call_id, tool, position, result_position, status,
  CASE WHEN is_placed THEN row_number() OVER (PARTITION BY conv_id, is_placed ORDER BY level, position) - 1 END AS place,
  CASE WHEN NOT is_call THEN '' WHEN asked IS NULL THEN 'text: missing' WHEN length(asked) < 1 THEN 'text: minLength' WHEN length(asked) > 2000 THEN 'text: maxLength' ELSE '' END AS errors,
  is_call AND asked IS NOT NULL AND length(asked) BETWEEN 1 AND 2000 AS valid,
  CASE WHEN is_placed THEN '{"arguments":{' || coalesce('"text":' || to_json(asked) || ',', '') || '"turn":' || position || '},"id":' || to_json(call_id)
    || ',"name":"reply","result":' || coalesce(to_json(answered), 'null') || '}' END AS canonical
FROM met
"""

ORACLE_SQL: dict[str, str] = {"op7_tool_calls": _OP7}

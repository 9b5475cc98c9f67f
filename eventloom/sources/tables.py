"""Engine tables over the driver's star schema, and the parameters of a run.

decision(trigger_number, run_number, trigger_timestamp, trigger_type); request(trigger_number, source_id,
window_begin, window_end); fragment(trigger_number, source_id, size_bytes, arrival...); primitive(origin,
time_start, adc, type).  Ticks are microseconds since 1970, long; types are 64-bit masks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RunConfig:
    """Parameters of a run; the defaults are the usual test values."""

    max_time_window: int = 0
    trigger_record_timeout_ms: int = 0
    busy_threshold: int = 2
    free_threshold: int = 1
    td_send_retries: int = 5
    data_storage_prescale: int = 1
    min_write_retry_ms: float = 1
    max_write_retry_ms: float = 1000
    write_retry_factor: float = 2
    max_file_size: int = 4 * 1024**3
    free_space_safety_factor: float = 5
    mode: str = "all-per-file"
    op_env: str = "test"
    file_type_prefix: str = "raw"
    run_number_prefix: str = "run"
    digits_for_run_number: int = 6
    digits_for_file_index: int = 4
    digits_for_record_number: int = 5
    digits_for_sequence_number: int = 4
    tp_accumulation_interval: int = 3_600_000_000
    clock_speed_hz: float = 62_500_000.0

    def __post_init__(self) -> None:
        if self.busy_threshold < self.free_threshold:
            raise ValueError("busy_threshold is below free_threshold")
        if self.mode not in ("all-per-file", "one-event-per-file"):
            raise ValueError(f"unknown mode {self.mode}")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(time: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {time})")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trigger_number"),
        F.year("o_orderdate").cast("long").alias("run_number"),
        ticks("o_orderdate").alias("trigger_timestamp"),
        F.when(F.col("o_orderstatus") == "F", bit.bitwiseOR(F.lit(32).cast("long"))).otherwise(bit).alias("trigger_type"),
        F.col("o_custkey").alias("customer"),
    )


def requests(decided: DataFrame) -> DataFrame:
    """Component requests: 1 + trigger % 7 sources, with windows that widen with the source."""
    rows = decided.withColumn("source_id", F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.col("trigger_number") % 7)))
    return rows.select("trigger_number", "run_number", "source_id", (F.col("trigger_timestamp") - 10 * F.col("source_id")).alias("window_begin"), (F.col("trigger_timestamp") + 100 * F.col("source_id")).alias("window_end"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrival within a trigger and source is (arrival, part, supplier), which is total."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("trigger_number"),
        F.col("l_linenumber").cast("long").alias("source_id"),
        (F.col("l_quantity") * 1000).cast("long").alias("size_bytes"),
        ticks("l_shipdate").alias("arrival"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
    )


def run_keyed(decided: DataFrame, fragments: DataFrame, runs: int = 3) -> tuple[DataFrame, DataFrame]:
    """Decisions and fragments whose trigger numbers come again in each of ``runs`` runs."""
    key = {"run_number": F.col("trigger_number") % runs, "trigger_number": F.expr(f"trigger_number div {runs}")}
    return decided.withColumns(key), fragments.withColumns(key)


def primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seqno"),
        F.year("ts").cast("long").alias("run_number"),
        F.col("user_id").alias("origin"),
        ticks("ts").alias("time_start"),
        F.col("value").alias("adc"),
        F.when(F.col("event_type") == "signup", "heartbeat").otherwise("payload").alias("type"),
    )


def sets(tps: DataFrame, width: int = 5_400_000_000) -> DataFrame:
    """Sets of primitives as a producer sends them: those of one origin in stretches of ``width`` ticks.

    A stretch is bounded by its time, so its list is too.
    """
    packed = tps.groupBy("run_number", "origin", F.expr(f"time_start div {width}").alias("packet")).agg(
        F.sort_array(F.collect_list("time_start")).alias("objects"), F.min("seqno").alias("seqno")
    )
    return packed.select("seqno", "run_number", "origin", F.element_at("objects", 1).alias("start_time"), F.element_at("objects", -1).alias("end_time"), "objects")


def builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_name").alias("connection_name"))


def source_map(spark: SparkSession, sources: int = 50) -> DataFrame:
    """Where each source is read out: a dimension made by rule."""
    return spark.range(1, sources + 1).select(F.col("id").alias("source_id"), F.lit(3).alias("detector_id"), F.expr("id div 10").alias("crate_id"), F.expr("id % 10").alias("slot_id"), F.expr("id % 4").alias("stream_id"))

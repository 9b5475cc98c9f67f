"""Checks after a run: counts, sizes, and what the logs say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fragment_checks(fragments: DataFrame, expectations: DataFrame) -> DataFrame:
    """expectations: source_id, min_size_bytes, max_size_bytes. By source: fragments, how many have a size outside, and the verdict."""
    met = fragments.join(expectations, "source_id")
    outside = (F.col("size_bytes") < F.col("min_size_bytes")) | (F.col("size_bytes") > F.col("max_size_bytes"))
    out = met.groupBy("source_id").agg(F.count("*").alias("n_fragments"), F.count(F.when(outside, 1)).alias("n_outside"))
    return out.withColumn("passed", F.col("n_outside") == 0)


def event_counts(records: DataFrame, expected: Column, tolerance: float = 0.1) -> DataFrame:
    """Records by run against what was expected, within ceil(tolerance * expected)."""
    out = records.groupBy("run_number").agg(F.count("*").alias("n_events")).withColumn("expected", expected.cast("long"))
    return out.withColumn("passed", F.abs(F.col("n_events") - F.col("expected")) <= F.ceil(F.col("expected") * tolerance))


def record_checks(records: DataFrame) -> DataFrame:
    """records: run_number, requested, received. By run: records, how many lack fragments or have too many, and the verdict."""
    out = records.groupBy("run_number").agg(F.count("*").alias("n_records"), F.count(F.when(F.col("received") != F.col("requested"), 1)).alias("n_wrong"))
    return out.withColumn("passed", F.col("n_wrong") == 0)


def file_counts(filled: DataFrame, expected: Column) -> DataFrame:
    """filled: run_number, file_index. Files by run against what was expected."""
    out = filled.groupBy("run_number").agg(F.countDistinct("file_index").alias("n_files")).withColumn("expected", expected.cast("long"))
    return out.withColumn("passed", F.col("n_files") == F.col("expected"))


def log_counts(lines: DataFrame) -> DataFrame:
    """lines: file, line_number, line. ``Sent N TDs.`` holds for the next ``End of run R`` of its file: run_number, n_sent.

    A window sees only the lines that match, within one file.
    """
    sent = F.regexp_extract("line", r"Sent (\d+) TDs\.", 1)
    ended = F.regexp_extract("line", r"End of run (\d+)", 1)
    rows = lines.where(r"line RLIKE 'Sent \\d+ TDs\\.|End of run \\d+'").select("file", "line_number", F.when(sent != "", sent.cast("long")).alias("sent"), F.when(ended != "", ended.cast("long")).alias("run_number"))
    before = F.last("sent", ignorenulls=True).over(Window.partitionBy("file").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("n_sent", before).where("run_number IS NOT NULL").select("run_number", "n_sent")

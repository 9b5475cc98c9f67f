"""Synthetic producers: fragments that answer requests, and time syncs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fake_fragments(asked: DataFrame, tick_diff: int, frame_size: int, header: int = 72, run: int | None = None) -> DataFrame:
    """A reply to each request: ceil(window / tick_diff) frames. The payload is only sized; ``payload_of`` makes it."""
    frames = F.expr(f"(window_end - window_begin + {tick_diff - 1}) div {tick_diff}")
    out = asked.withColumn("n_frames", frames).withColumn("size_bytes", header + F.col("n_frames") * frame_size)
    return out.withColumn("run_number", F.lit(run).cast("long")) if run is not None else out


def payload_of(frames: str = "n_frames", frame_size: int = 7200):
    """A payload of zero bytes."""
    return F.expr(f"cast(repeat(char(0), cast({frames} * {frame_size} as int)) as binary)")


def time_syncs(spark: SparkSession, clock_hz: float = 62_500_000.0, rows_per_second: int = 10, run: int = 1) -> DataFrame:
    """A stream of clock readings, ten a second: sequence_number, daq_time (ticks), system_time (ns), run_number."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    micros = F.unix_micros("timestamp")
    return rows.select(F.col("value").alias("sequence_number"), (micros * F.lit(clock_hz / 1e6)).cast("long").alias("daq_time"), (micros * 1000).alias("system_time"), F.lit(run).cast("long").alias("run_number"))

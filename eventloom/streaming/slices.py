"""Time slices over streams of primitives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.ranking import first_rows
from ..operators import slices
from ..sources import tables
from ..sources.scratch import staged
from .assembly import _as_stream, in_order, last_updates, run_now


def per_origin(tps: DataFrame, width: int) -> DataFrame:
    """Primitives, first and last time by slice and origin."""
    rows = slices.payload(tps).withColumn("slice_index", F.expr(f"time_start div {width}"))
    return rows.groupBy("slice_index", "origin").agg(F.count("*").alias("n_tps"), F.min("time_start").alias("first_time"), F.max("time_start").alias("last_time"))


def closed(tps: DataFrame, width: int, cooling_seconds: int) -> DataFrame:
    """Slices emitted once the stream's time is ``cooling_seconds`` past their end (output mode append).

    tps: time (timestamp), origin.  A slice is a tumbling window; later primitives of a closed slice are dropped.
    ``closed_when_quiet`` has the rule by silence.
    """
    rows = tps.withWatermark("time", f"{cooling_seconds} seconds")
    each = rows.groupBy(F.window("time", f"{width} microseconds").alias("w"), "origin").agg(F.count("*").alias("n_tps"))
    return each.select(F.col("w.start").alias("slice_begin"), "origin", "n_tps")


_QUIET = "run_number long, slice_index long, n long, first_time long, last_time long"


def closed_when_quiet(tps: DataFrame, width: int, silence: int, clock: str = "event") -> DataFrame:
    """Slices emitted when nothing came for them during more than ``silence`` microseconds; each update sets the timer anew.

    tps: run_number, time_start, arrival (microseconds) and, for clock ``event``, ``time`` with a watermark.  A slice that gets
    more after it was emitted opens again and is emitted again, for ``write_once`` to turn down.
    """
    if clock not in ("event", "processing"):
        raise ValueError(f"unknown clock {clock}")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, now = [], state.getCurrentProcessingTimeMs() * 1000
        n, first, last, update = state.get if state.exists else (0, 0, 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, n, first, last)], columns=["run_number", "slice_index", "n", "first_time", "last_time"])
            return
        got = pd.concat(list(batches), ignore_index=True).sort_values("arrival", kind="stable")
        for t, at in zip(got["time_start"].tolist(), got["arrival"].tolist() if clock == "event" else [now] * len(got)):
            if n and at - update > silence:
                out.append((*key, n, first, last))
                n = 0
            n, first, last, update = n + 1, min(first, t) if n else t, max(last, t) if n else t, at
        state.update((n, first, last, update))
        if clock == "event":
            state.setTimeoutTimestamp(max((update + silence) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        else:
            state.setTimeoutDuration(max(1, silence // 1000))
        if out:
            yield pd.DataFrame(out, columns=["run_number", "slice_index", "n", "first_time", "last_time"])

    rows = tps.withColumn("slice_index", F.expr(f"time_start div {width}"))
    mode = GroupStateTimeout.EventTimeTimeout if clock == "event" else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("run_number", "slice_index").applyInPandasWithState(step, _QUIET, "n long, first long, last long, update long", "append", mode)


def flushed(emitted: DataFrame, tps: DataFrame, width: int, silence: int) -> DataFrame:
    """The flush at the end of a run: what was emitted, and every slice that is still open as it stands.

    A slice's closings are emitted in order, so those after the ones that were emitted are open.
    """
    whole = slices.quiet_slices(tps, width, silence)
    there = emitted.groupBy("run_number", "slice_index").agg(F.count("*").alias("_n"))
    left = whole.join(there, ["run_number", "slice_index"], "left").where("closing >= coalesce(_n, 0)")
    names = ["run_number", "slice_index", "n", "first_time", "last_time"]
    return emitted.select(*names).unionByName(left.select(*names))


def write_once(batch: DataFrame, path: str, key: list[str], number: int | None = None) -> int:
    """Appends slices that aren't in the store yet and returns how many came too late; for ``foreachBatch``.

    The store has a folder for each value of the first key column, so only the runs that the batch has are read, and of
    them only the batch's range of the other key columns.  With the batch's ``number`` a batch that is run again replaces
    what it wrote before instead of finding itself there.
    """
    spark = batch.sparkSession
    batch = staged(batch, "batch")
    fresh = first_rows(batch, key, [c for c in batch.columns if c not in key]) if len(batch.columns) > len(key) else batch.dropDuplicates(key)
    run, *rest = key
    seen = batch.agg(*[f(c).alias(f"_{k}{i}") for i, c in enumerate(rest) for k, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("_n")).first()
    runs = [r[0] for r in batch.select(run).distinct().collect()]
    mark = f"batch={number}" if number is not None else "batch=none"
    try:
        there = spark.read.parquet(path).where(F.col(run).isin(runs))
        if number is not None:
            there = there.where(F.col("batch").cast("string") != str(number))
        for i, c in enumerate(rest):
            there = there.where(F.col(c).between(seen[f"_lo{i}"], seen[f"_hi{i}"]))
        fresh = fresh.join(there.select(*key), key, "left_anti")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    fresh = staged(fresh, "fresh")
    n = fresh.count()
    for r in runs:
        fresh.where(F.col(run) == r).drop(run).write.mode("append" if number is None else "overwrite").parquet(f"{path}/{run}={r}/{mark}")
    return seen["_n"] - n


def replay_quiet(tps: DataFrame, width: int, silence: int, batches: int = 4) -> DataFrame:
    """``closed_when_quiet`` over a replay in micro-batches, and the flush at its end."""
    rows = tps.select("run_number", "time_start", "arrival")
    stream = in_order(rows, "arrival", batches).withColumn("time", F.timestamp_micros("arrival")).withWatermark("time", "0 seconds")
    return flushed(run_now(closed_when_quiet(stream, width, silence)).drop("batch"), rows, width, silence)


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly slices with the events table read as a stream."""
    rows = _as_stream(spark, sf_dir, "events")
    tps = rows.select(F.col("user_id").alias("origin"), tables.ticks("ts").alias("time_start"), F.when(F.col("event_type") == "signup", "heartbeat").otherwise("payload").alias("type"))
    return last_updates(per_origin(tps, 3_600_000_000), ["slice_index", "origin"])

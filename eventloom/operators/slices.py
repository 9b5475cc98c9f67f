"""Streams of primitives in time slices: replication, edges, bundles, numbering, lateness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import first_rows, grouped_rank, running


def payload(tps: DataFrame) -> DataFrame:
    """Heartbeats are counted elsewhere and don't take part."""
    return tps.where("type <> 'heartbeat'")


def in_slices(sets: DataFrame, width: int) -> DataFrame:
    """Each set in every slice from its start to its end, inclusive; at a slice's edge only the primitives inside stay.

    A set that reaches an edge gets the first and last primitive that stay as its bounds, and none if none
    stays.  Slices are half-open and aligned to zero.
    """
    rows = sets.withColumn("slice_index", F.explode(F.sequence(F.expr(f"start_time div {width}"), F.expr(f"end_time div {width}"))))
    rows = rows.withColumns({"slice_begin": F.col("slice_index") * width, "slice_end": (F.col("slice_index") + 1) * width})
    edge = (F.col("start_time") <= F.col("slice_begin")) | (F.col("end_time") >= F.col("slice_end"))
    inside = F.filter("objects", lambda t: (t >= F.col("slice_begin")) & (t < F.col("slice_end")))
    rows = rows.withColumn("_edge", edge).withColumn("objects", F.when(edge, inside).otherwise(F.col("objects"))).where("size(objects) > 0")
    return rows.withColumns(
        {"start_time": F.when(F.col("_edge"), F.element_at("objects", 1)).otherwise(F.col("start_time")), "end_time": F.when(F.col("_edge"), F.element_at("objects", -1)).otherwise(F.col("end_time"))}
    ).drop("_edge")


def first_windows(sliced: DataFrame) -> DataFrame:
    """Of sets that start at one time in a slice and origin the first to arrive stays."""
    return first_rows(sliced, ["run_number", "slice_index", "origin", "start_time"], ["seqno"])


def bundles(sliced: DataFrame) -> DataFrame:
    """One row per slice and origin: its sets in time order as one list.

    A bundle is one object by its meaning, a fragment of its slice; the list is bounded by what one origin sends in
    one slice's width.  Where that is too much, ``ordered_sets`` has the same as rows.
    """
    each = sliced.groupBy("run_number", "slice_index", "origin").agg(F.count("*").alias("n_sets"), F.sort_array(F.collect_list(F.struct("start_time", "objects"))).alias("s"))
    return each.select("run_number", "slice_index", "origin", "n_sets", F.flatten(F.col("s.objects")).alias("objects"))


def ordered_sets(sliced: DataFrame) -> DataFrame:
    """The sets of each bundle as rows with ``nth`` (from 0, in time order): a bundle of any size."""
    return grouped_rank(sliced, ["run_number", "slice_index", "origin"], ["start_time", "seqno"], "nth")


def quiet_slices(rows: DataFrame, width: int, silence: int) -> DataFrame:
    """Slices as they close when nothing came for them during more than ``silence`` ticks: run_number, slice_index, closing, n, first_time, last_time.

    rows: run_number, time_start, arrival (ticks).  A slice that gets more after it closed opens again, so it may close several
    times (``closing`` counts from 0); only the first is written by a store that takes a slice once.  Rows of one arrival
    are combined first, so a hot slice is a row for each tick at most.
    """
    each = rows.groupBy("run_number", F.expr(f"time_start div {width}").alias("slice_index"), "arrival").agg(F.count("*").alias("n"), F.min("time_start").alias("a"), F.max("time_start").alias("b"))
    order = Window.partitionBy("run_number", "slice_index").orderBy("arrival")
    opens = (F.col("arrival") - F.lag("arrival").over(order) > silence).cast("int")
    parts = each.withColumn("_open", F.coalesce(opens, F.lit(0))).withColumn("closing", F.sum("_open").over(order).cast("long"))
    return parts.groupBy("run_number", "slice_index", "closing").agg(F.sum("n").alias("n"), F.min("a").alias("first_time"), F.max("b").alias("last_time"))


def first_emission(rows: DataFrame, width: int, silence: int) -> DataFrame:
    """When each run first emits a slice, and the least slice index at that time: run_number, emitted, first_index.

    rows: run_number, time_start, arrival.  The first emission is at the first arrival by which some slice had had nothing
    for ``silence`` ticks; slices seen up to it are numbered from the least, which stays as it is from then on.  A run
    without emission has no row.
    """
    each = rows.groupBy("run_number", F.expr(f"time_start div {width}").alias("slice_index"), "arrival").agg(F.count("*").alias("_n"))
    then = F.lead("arrival").over(Window.partitionBy("run_number", "slice_index").orderBy("arrival"))
    none = F.lit(None).cast("long")
    waits = each.select("run_number", (F.col("arrival") + silence).alias("time"), F.lit(1).alias("kind"), then.alias("_next"), none.alias("_came"))
    ticks = each.select("run_number", "arrival").distinct().select("run_number", F.col("arrival").alias("time"), F.lit(0).alias("kind"), none.alias("_next"), F.col("arrival").alias("_came"))
    # of each update: the first arrival at which its slice has been quiet for long enough, if nothing came for it until then
    met = running(waits.unionByName(ticks), ["run_number"], [F.desc("time"), F.asc("kind"), F.asc("_next")], {"at": ("last", "_came")}).where("kind = 1 and (_next is null or at < _next)")
    emitted = met.groupBy("run_number").agg(F.min("at").alias("emitted")).where("emitted is not null")
    # a row a run: hashed by the run, a join would put all rows of a run into one task
    return each.join(F.broadcast(emitted), "run_number").where("arrival <= emitted").groupBy("run_number", "emitted").agg(F.min("slice_index").alias("first_index"))


def mark_tardy(rows: DataFrame, first: DataFrame, width: int) -> DataFrame:
    """Adds slice_index and ``is_tardy``: the row came after its run's first emission for a slice before the first one; such rows are dropped, and counted.

    first: as from ``first_emission``; one row per run, which is broadcast, so a run of any size stays spread.
    """
    met = rows.withColumn("slice_index", F.expr(f"time_start div {width}")).join(F.broadcast(first), "run_number", "left")
    tardy = (F.col("arrival") > F.col("emitted")) & (F.col("slice_index") < F.col("first_index"))
    return met.withColumn("is_tardy", F.coalesce(tardy, F.lit(False))).drop("emitted", "first_index")


def numbered(slices: DataFrame) -> DataFrame:
    """slice_number counts from 1 at the run's first slice; gaps stay."""
    first = slices.groupBy("run_number").agg(F.min("slice_index").alias("_first"))
    return slices.join(first, "run_number").withColumn("slice_number", F.col("slice_index") - F.col("_first") + 1).drop("_first")


def tardiness(rows: DataFrame, groups: list[str], order: list[str], width: int, ticks_per_second: float) -> DataFrame:
    """How far each row's slice lies behind the latest slice seen up to it, in seconds: ``largest_index``, ``tardy_seconds``."""
    out = running(rows, groups, order, {"largest_index": ("max", "slice_index")})
    return out.withColumn("tardy_seconds", (F.col("largest_index") - F.col("slice_index")) * F.lit(width / ticks_per_second))


def rates(rows: DataFrame, groups: list[str], order: str, time: str, arrival_ms: str | None = None) -> DataFrame:
    """Rows, first and last time in order of arrival, and rows a second.

    The span is that of the times (microseconds), or with ``arrival_ms`` that of the wall clock; then
    ``inferred_clock`` tells how many ticks went by in a second of it. Null where there is no span.
    """
    found = [F.count("*").alias("n"), F.min_by(time, order).alias("first_time"), F.max_by(time, order).alias("last_time")]
    ticks = F.col("last_time") - F.col("first_time")
    if arrival_ms is None:
        return rows.groupBy(*groups).agg(*found).withColumn("per_second", F.when(ticks > 0, F.col("n") / (ticks / F.lit(1e6))))
    out = rows.groupBy(*groups).agg(*found, (F.max(arrival_ms) - F.min(arrival_ms)).alias("elapsed_ms"))
    some = F.col("elapsed_ms") > 0
    return out.withColumns({"per_second": F.when(some, 1e3 * F.col("n") / F.col("elapsed_ms")), "inferred_clock": F.when(some, 1e3 * ticks / F.col("elapsed_ms"))})

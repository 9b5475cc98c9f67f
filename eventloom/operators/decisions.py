"""Decisions: run filters, types, extents, time slices and data requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import grouped_rank
from ..functions.scalars import crop, overlaps

#: What tells decisions apart: a trigger number may come again in another run.
DECISION = ["run_number", "trigger_number"]
#: Requests that meet their slices in one task.
TASK_REQUESTS = 100_000


def of_run(df: DataFrame, run: int | Column) -> DataFrame:
    """Rows of the current run; ``foreign`` has the others. A null run number is foreign."""
    return df.where(F.col("run_number").eqNullSafe(run))


def foreign(df: DataFrame, run: int | Column) -> DataFrame:
    return df.where(~F.col("run_number").eqNullSafe(run))


def filter_counts(df: DataFrame, run: int | Column, kept: str = "kept", dropped: str = "dropped") -> DataFrame:
    """One row: how many rows are of the run, and how many are foreign, so that what a filter drops is counted."""
    own = F.col("run_number").eqNullSafe(run)
    return df.agg(F.count(F.when(own, 1)).alias(kept), F.count(F.when(~own, 1)).alias(dropped))


def type_bits(mask: Column) -> Column:
    """Positions of the set bits, 0 to 63; none for null."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(mask, i) == 1)
    return F.when(mask.isNull(), F.array().cast("array<int>")).otherwise(bits)


def by_type(df: DataFrame, mask: str = "trigger_type") -> DataFrame:
    """A row for every set bit, so counts by type add up to more than the decisions."""
    return df.withColumn("type", F.explode(type_bits(F.col(mask))))


def extents(requests: DataFrame, decision: list[str] = DECISION) -> DataFrame:
    """Earliest begin, latest end and width of each decision's requests."""
    each = requests.groupBy(*decision).agg(F.min("window_begin").alias("extent_begin"), F.max("window_end").alias("extent_end"))
    return each.withColumn("width", F.col("extent_end") - F.col("extent_begin"))


def slices(extent: DataFrame, max_window: int, decision: list[str] = DECISION) -> DataFrame:
    """Cuts each extent into sequences of at most ``max_window`` ticks (0: none).

    The last sequence number is (width - 1) div window; a decision without width has one sequence.
    """
    most = F.when(F.col("width") > 0, F.expr(f"(width - 1) div {max_window}")).otherwise(F.lit(0)) if max_window > 0 else F.lit(0)
    rows = extent.withColumn("max_sequence_number", most.cast("long")).withColumn("sequence_number", F.explode(F.sequence(F.lit(0).cast("long"), "max_sequence_number")))
    begin = F.col("extent_begin") + F.col("sequence_number") * max_window
    end = F.least(begin + max_window, F.col("extent_end")) if max_window > 0 else F.col("extent_end")
    return rows.select(*decision, "sequence_number", "max_sequence_number", begin.alias("slice_begin"), end.alias("slice_end"))


def data_requests(sliced: DataFrame, requests: DataFrame, decision: list[str] = DECISION) -> DataFrame:
    """Each slice's requests, cropped to it.  Ends are closed: a window that ends on a bound is in both slices.

    The join is on the decision, so the overlap is only a filter within one.  A decision grows into many rows here, so
    the tasks are as many as the requests need: Spark would merge them by what they read, which is small.
    """
    tasks = requests.count() // TASK_REQUESTS + 1
    sliced, requests = sliced.repartition(tasks, *decision), requests.repartition(tasks, *decision)
    window, bounds = (F.col("window_begin"), F.col("window_end")), (F.col("slice_begin"), F.col("slice_end"))
    met = sliced.join(requests, decision).where(overlaps(*window, *bounds))
    begin, end = crop(*window, *bounds)
    return met.select(*decision, "sequence_number", "source_id", begin.alias("window_begin"), end.alias("window_end"))


def duplicates(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """Adds ``is_duplicate``: all rows of a key but the first in order. A key may hold any share of the rows."""
    return grouped_rank(df, key, order, "_nth").withColumn("is_duplicate", F.col("_nth") > 0).drop("_nth")


def routed(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Adds the route's destination, null where no route is known."""
    return requests.join(routes, "source_id", "left")


def invalid(requests: DataFrame, routes: DataFrame) -> DataFrame:
    return requests.join(routes, "source_id", "left_anti")

"""Ranks and running values within groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged

_ROW = (1 << 33) - 1


def _laid(df: DataFrame, groups: list[str], order: list[str | Column], name: str) -> DataFrame:
    """The rows range-partitioned and sorted by group and order, written, with ``_at`` (their place) and ``_part`` (their stretch)."""
    sorted_ = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order).withColumn("_at", F.monotonically_increasing_id())
    return staged(sorted_, name).withColumn("_part", F.shiftright("_at", 33))


def _with_pieces(laid: DataFrame, pieces: DataFrame, groups: list[str]) -> DataFrame:
    """Joins the one row of each stretch and group back to its rows; a null group is a group like any other."""
    names = {g: f"_g{k}" for k, g in enumerate(groups)}
    right = pieces.withColumnsRenamed({"_part": "_p", **names})
    met = laid["_part"] == right["_p"]
    for g, own in names.items():
        met = met & laid[g].eqNullSafe(right[own])
    return laid.join(right, met).drop("_p", *names.values())


def grouped_rank(df: DataFrame, groups: list[str], order: list[str | Column], rank: str = "rank", total: str | None = None) -> DataFrame:
    """Adds ``rank`` (long, from 0) in the given order within each group, and the group's row count as ``total``.

    The rows are range-partitioned and sorted by group and order, so a group with a third of all rows
    spreads over a third of the partitions.  The only thing that a window sees is one row for each
    group and partition.  Rows that tie in ``order`` are told apart by nothing: make the order total,
    or let tied rows be equal in all that the caller uses.  Null is a group of its own; nulls come first in order.
    """
    laid = _laid(df, groups, order, "ranked").withColumn("_row", F.col("_at").bitwiseAND(F.lit(_ROW)))
    pieces = laid.groupBy("_part", *groups).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    each = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(each.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("_part", *groups, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(each).alias("_total"))
    out = _with_pieces(laid, pieces, groups).withColumn(rank, F.col("_row") + F.col("_shift"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_at", "_part", "_row", "_shift", "_total")


def running(df: DataFrame, groups: list[str], order: list[str | Column], values: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds running values, up to and with each row in the given order within its group.

    values: new column -> (``sum``, ``max``, ``max_before`` or ``last``, column); ``max_before`` leaves the row itself out,
    ``last`` is the newest value that isn't null.  Each
    range-partitioned stretch of a group runs on its own and starts from what the stretches before it amount to.  The
    order must be total.  Null is a group of its own.
    """
    laid = _laid(df, groups, order, "running")
    agg = {"sum": F.sum, "max": F.max, "max_before": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    over_all = {"sum": F.sum, "max": F.max, "max_before": F.max, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at")))}
    pieces = laid.groupBy("_part", *groups).agg(*[over_all[how](c).alias(f"_all_{new}") for new, (how, c) in values.items()])
    each = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_part", *groups, *[agg[how](f"_all_{new}").over(each).alias(f"_before_{new}") for new, (how, _) in values.items()])
    rows = Window.partitionBy("_part", *groups).orderBy("_at")
    out = _with_pieces(laid, pieces, groups)
    for new, (how, c) in values.items():
        inside = rows.rowsBetween(Window.unboundedPreceding, -1 if how == "max_before" else 0)
        here, before = agg[how](c).over(inside), F.col(f"_before_{new}")
        join = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": F.greatest, "max_before": F.greatest, "last": F.coalesce}[how]
        out = out.withColumn(new, join(here, before))
    return out.drop("_at", "_part", *[f"_before_{new}" for new in values])


def first_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ascending order of columns, nulls first; combined before the shuffle, so a key of any size is no trouble."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")).select(*key, "_first.*").select(*df.columns)

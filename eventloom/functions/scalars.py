"""Scalar functions on ticks, windows and names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def slice_index(ticks: Column, width: int) -> Column:
    """Number of the time slice of a tick, aligned to zero; truncates toward zero."""
    return F.call_function("div", ticks, F.lit(width).cast("long"))


def seconds(ticks: Column, clock_hz: float = 62_500_000.0) -> Column:
    return ticks / F.lit(clock_hz)


def crop(begin: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """A window cut to bounds."""
    return F.greatest(low, begin), F.least(high, end)


def inside(time: Column, begin: Column, end: Column) -> Column:
    """Half-open: the end is outside."""
    return (time >= begin) & (time < end)


def overlaps(begin: Column, end: Column, low: Column, high: Column) -> Column:
    """Closed at both ends: windows that touch overlap."""
    return (begin <= high) & (end >= low)


def valid(value: Column, invalid: int) -> Column:
    """A value with its sentinel as null, for use where rows come in."""
    return F.when(value != invalid, value)


def name_of(value: Column, names: Mapping[int, str], unknown: str = "unknown") -> Column:
    """Name of an enumerated value."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), F.lit(unknown)) if names else F.lit(unknown)


def value_of(name: Column, names: Mapping[int, str]) -> Column:
    """Value of a name; null for one that isn't known."""
    pairs = [F.lit(x) for value, text in names.items() for x in (text, value)]
    return F.element_at(F.create_map(*pairs), name) if names else F.lit(None).cast("int")

"""Writing: prescale, completion tokens, file rollover and names, retry schedule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.ranking import _ROW, _laid, first_rows, grouped_rank
from ..sources.scratch import staged
from ..sources.tables import RunConfig

#: Records whose sizes are packed into one array when files are filled.
CHUNK = 1024


def prescaled(records: DataFrame, groups: list[str], order: list[str | Column], prescale: int) -> DataFrame:
    """Adds ``nth`` (from 1, by arrival in the group) and ``is_stored``: the first and every ``prescale``-th after it."""
    out = grouped_rank(records, groups, order, "_rank").withColumn("nth", F.col("_rank") + 1).drop("_rank")
    return out.withColumn("is_stored", F.lit(True) if prescale <= 1 else F.col("nth") % prescale == 1)


def prescaled_of_run(records: DataFrame, run: int, order: list[str | Column], prescale: int) -> DataFrame:
    """A writer's records, prescaled by arrival and then cut to its run: records of another run count as received and move the prescale on, but aren't stored.

    Adds ``nth``, ``is_stored`` and ``is_foreign``.
    """
    out = prescaled(records, [], order, prescale).withColumn("is_foreign", ~F.col("run_number").eqNullSafe(run))
    return out.withColumn("is_stored", F.col("is_stored") & ~F.col("is_foreign"))


def sequences(records: DataFrame) -> DataFrame:
    """records: trigger_number, max_sequence_number, a row per sequence written. One row per trigger, with ``has_token``."""
    out = records.groupBy("trigger_number").agg(F.count("*").alias("n_written"), F.max("max_sequence_number").alias("max_sequence_number"))
    return out.withColumn("has_token", F.col("n_written") > F.col("max_sequence_number"))


def tokens(records: DataFrame, destination: Column) -> DataFrame:
    """A completion token for every trigger all of whose sequences are written."""
    return sequences(records).where("has_token").select("trigger_number", destination.alias("decision_destination"))


def per_event_files(records: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """One file for each trigger: ``file_index`` counts triggers in order from 0. Ranks of distinct triggers, so a hot run is split."""
    triggers = records.groupBy(*groups, "trigger_number").agg(*[F.min(c).alias(c) for c in order if c not in (*groups, "trigger_number")])
    ranked = grouped_rank(triggers, groups, [*order] if "trigger_number" in order else [*order, "trigger_number"], "file_index")
    keys = [*groups, "trigger_number"]
    named = ranked.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(keys)], "file_index")
    met = F.lit(True)
    for k, c in enumerate(keys):
        met = met & records[c].eqNullSafe(named[f"_g{k}"])
    return records.join(named, met).drop(*[f"_g{k}" for k in range(len(keys))])


def fill(sizes: np.ndarray, most: int, held: int) -> tuple[list[int], int]:
    """Places at which a file opens, and bytes in the last file, when ``sizes`` follow ``held`` bytes.

    A file is closed when it holds something and the next record doesn't fit.  One search for each file, whatever it holds.
    """
    ends = np.cumsum(sizes)
    n, at, base, opened = len(sizes), 0, -held, []
    while at < n:
        # the first record that doesn't fit what is open
        k = int(np.searchsorted(ends, base + most, "right"))
        begin = int(ends[k - 1]) if k else 0
        if k < n and begin == base:
            # alone in its file and too large: it stays, and the next one opens a file
            k += 1
            begin = int(ends[k - 1])
        if k >= n:
            break
        opened.append(k)
        base, at = begin, k
    return opened, int(ends[-1] - base) if n else held


def rollover(records: DataFrame, groups: list[str], order: list[str], size: str, most: int, start: tuple[int, int] = (0, 0)) -> DataFrame:
    """Adds ``file_index`` in each writer: greedy filling in order, no record split, the first always fits.

    ``start``: index of the file that is open, and the bytes in it.  Filling is sequential by nature, but only the sizes
    take part: a writer's sizes, packed into arrays of ``CHUNK`` records, pass through one task as a stream of 8
    bytes a record, an array at a time, and give where files open.  Each record then counts the openings up to it in
    its own array, side by side.  No record but its size meets another in a task.
    """
    laid = _laid(records.withColumn("_size", _bytes(size)), groups, order, "rollover")
    return _streamed(laid, groups, most, start).drop("_at", "_part", "_size")


def _bytes(size: str) -> Column:
    return F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))


def _same(left: DataFrame, right: DataFrame, names: dict[str, str]) -> Column:
    """Equality of left and right columns; null is equal to null."""
    met = F.lit(True)
    for here, there in names.items():
        met = met & left[here].eqNullSafe(right[there])
    return met


def _streamed(laid: DataFrame, groups: list[str], most: int, start: tuple[int, int] = (0, 0)) -> DataFrame:
    """``rollover`` of rows that are laid in order, with ``_at``, ``_part`` and ``_size``."""
    name = F.to_json(F.struct(*groups)) if groups else F.lit("")
    laid = laid.withColumns({"_writer": name, "_chunk": F.expr(f"(_at & {_ROW}) div {CHUNK}")})
    key = ["_writer", "_part", "_chunk"]
    packed = laid.groupBy(*key).agg(F.min("_at").alias("_first"), F.sort_array(F.collect_list(F.struct("_at", "_size"))).alias("_s")).select(*key, "_first", F.col("_s._size").alias("_sizes"))

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, index, held = None, 0, 0
        for rows in batches:
            out = []
            for w, part, chunk, first, sizes in rows.itertuples(index=False):
                if w != writer:
                    writer, (index, held) = w, start
                opened, held = fill(np.asarray(sizes, np.int64), most, held)
                out.append((w, part, chunk, index, [first + k for k in opened]))
                index += len(opened)
            yield pd.DataFrame(out, columns=[*key, "_files", "_opened"])

    streamed = packed.repartition("_writer").sortWithinPartitions("_writer", "_first")
    starts = streamed.mapInPandas(chain, "_writer string, _part long, _chunk long, _files long, _opened array<long>")
    index = F.col("_files") + F.size(F.filter("_opened", lambda x: x <= F.col("_at")))
    return laid.join(starts, key).withColumn("file_index", index).drop("_files", "_opened", "_writer", "_chunk")


def _changes(column: pa.Array, last: pa.Array | None) -> np.ndarray:
    """Where a value isn't that of the row before; ``last`` is the one before the first row, if any. Null is a value."""
    before = pa.concat_arrays([column[:1] if last is None else last, column[:-1]])
    null, gone = pc.is_null(column), pc.is_null(before)
    out = pc.if_else(pc.or_(null, gone), pc.xor(null, gone), pc.not_equal(column, before)).to_numpy(zero_copy_only=False)
    if last is None:
        out[0] = True
    return out


def openings(sizes: np.ndarray, fresh: np.ndarray, most: int, held: int) -> tuple[np.ndarray, int]:
    """Places at which a file opens, and bytes in the last one: ``fresh`` rows open one whatever fits; the rows before the first follow ``held`` bytes.

    What a file holds is looked up for all rows at once, as if each opened one; then the files follow each other.
    """
    n = len(sizes)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    bounds = np.append(np.flatnonzero(fresh), n)
    # the first row that doesn't fit; where nothing is held yet it stays, and the next one opens a file
    base = upto[:-1]
    k = np.searchsorted(upto[1:], base + most, "right")
    following = np.minimum(k + (upto[k] == base), bounds[np.searchsorted(bounds, np.arange(n), "right")]).tolist()
    k = int(np.searchsorted(upto[1:], most - held, "right"))
    at = min(k + int(upto[k] == -held), int(bounds[0]))
    opened = []
    while at < n:
        opened.append(at)
        at = following[at]
    return np.asarray(opened, np.int64), int(upto[-1] - upto[opened[-1]] if opened else held + upto[-1])


def _counted(n_groups: int, most: int) -> Column:
    """UDF over a stretch in order, of sizes, group columns and the trigger: files of the group opened in the stretch, and whether the row is of the stretch's first trigger."""

    @F.arrow_udf("nth long, head boolean")
    def count(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        last: list[pa.Array | None] = [None] * (n_groups + 1)
        held, nth, head = 0, 0, True
        for sizes, *keys in batches:
            n = len(sizes)
            if not n:
                yield pa.StructArray.from_arrays([pa.array([], pa.int64()), pa.array([], pa.bool_())], ["nth", "head"])
                continue
            begins = last[-1] is None
            changed = [_changes(c, v) for c, v in zip(keys, last)]
            last = [c[-1:] for c in keys]
            grouped = np.logical_or.reduce(changed[:-1]) if n_groups else np.arange(n) < begins
            fresh = grouped | changed[-1]
            opened, held = openings(sizes.to_numpy(zero_copy_only=False), fresh, most, held)
            opens = np.zeros(n, np.int64)
            opens[opened] = 1
            # counts begin anew with a group, whose first row always opens a file
            upto = np.cumsum(opens)
            starts = np.maximum.accumulate(np.where(grouped, np.arange(n), -1))
            counts = upto - np.where(starts < 0, -nth, upto[starts] - 1)
            nth = int(counts[-1])
            later = np.flatnonzero(fresh[1:] if begins else fresh)
            first = n if not len(later) else int(later[0]) + begins
            heads = np.arange(n) < (first if head else 0)
            head = head and not len(later)
            yield pa.StructArray.from_arrays([pa.array(counts), pa.array(heads)], ["nth", "head"])

    # it goes by the order of rows, so the sort before it must stay
    return count.asNondeterministic()


def event_files(records: DataFrame, groups: list[str], order: list[str], size: str, most: int) -> DataFrame:
    """One file for each trigger, and further ones where a trigger's records don't fit: size rollover and a new event open files alike.

    Triggers go by their first record in ``order``; ``file_index`` counts from 0 in each writer.

    The rows are laid once in the order in which they are written, and each stretch counts the files that open as it is sorted: a
    trigger begins a file, so only one that goes over a stretch's edge depends on the stretch before.  The sizes of such
    triggers, however large, are filled as in ``rollover``, and give the true count at the beginning of each stretch.
    """
    key = [*groups, "trigger_number"]
    rows, first = records, []
    if next((c for c in order if c not in groups), None) != "trigger_number":
        firsts = records.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first")).withColumnsRenamed({c: f"_k{k}" for k, c in enumerate(key)})
        rows = records.join(firsts, _same(records, firsts, {c: f"_k{k}" for k, c in enumerate(key)})).drop(*[f"_k{k}" for k in range(len(key))])
        first = ["_first"]
    by = [*groups, *first, "trigger_number", *[c for c in order if c not in key]]
    sorted_ = rows.withColumn("_size", _bytes(size)).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).drop(*first)
    plain = [F.col(c) if isinstance(records.schema[c].dataType, IntegralType) else F.to_json(F.struct(c)) for c in key]
    counted = sorted_.withColumn("_count", _counted(len(groups), most)("_size", *plain))
    counted = counted.select(*records.columns, "_size", "_at", F.col("_count.nth").alias("_nth"), F.col("_count.head").alias("_head"))
    laid = staged(counted, "event_files").withColumn("_part", F.shiftright("_at", 33))

    head = F.when(F.col("_head"), F.col("trigger_number"))
    parts = staged(laid.groupBy("_part", *groups).agg(F.max("_nth").alias("_n"), F.max(F.when(F.col("_head"), F.col("_nth"))).alias("_in_head"), F.max(head).alias("_trigger")), "parts")
    # one trigger for each stretch; its rows may lie in several
    heads = staged(parts.where("_in_head IS NOT NULL").select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate([*groups, "_trigger"])]).distinct(), "heads")
    cut = laid.join(heads, _same(laid, heads, {c: f"_k{k}" for k, c in enumerate(key)}), "left_semi")
    own = staged(_streamed(cut, key, most), "cut")
    pieces = own.groupBy("_part", *key).agg(F.max("file_index").alias("_last"))
    pieces = pieces.withColumn("_before", F.lag("_last").over(Window.partitionBy(*key).orderBy("_part"))).where("_before IS NOT NULL")
    # a head that goes on from the stretch before: its files are those of the trigger since then
    pieces = pieces.select(F.col("_part").alias("_p"), "_before", (F.col("_last") - F.col("_before")).alias("_true"))
    parts = parts.join(pieces, (parts["_part"] == pieces["_p"]) & parts["_in_head"].isNotNull(), "left")
    shift = F.coalesce(F.col("_true") - F.col("_in_head"), F.lit(0))
    each = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    base = F.coalesce(F.sum(F.col("_n") + shift).over(each.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = {"_part": "_p", **{g: f"_g{k}" for k, g in enumerate(groups)}}
    starts = staged(parts.select(*[F.col(c).alias(n) for c, n in names.items()], base.alias("_base"), shift.alias("_shift"), "_before"), "starts")

    goes_on = F.col("_head") & F.col("_before").isNotNull()
    here = laid.join(starts, _same(laid, starts, names)).where(~goes_on).withColumn("file_index", F.col("_base") + F.col("_nth") + F.col("_shift") - 1)
    on = own.join(starts, _same(own, starts, names)).where(goes_on).withColumn("file_index", F.col("_base") + F.col("file_index") - F.col("_before") - 1)
    return here.select(*records.columns, "file_index").unionByName(on.select(*records.columns, "file_index"))


def file_sizes(filled: DataFrame, groups: list[str], size: str) -> DataFrame:
    return filled.groupBy(*groups, "file_index").agg(F.count("*").alias("n_records"), F.sum(size).alias("file_bytes"))


def file_name(run: Column, index: Column, writer: Column, config: RunConfig, directory: str = ".", stamp: Column | None = None) -> Column:
    """``<dir>/<op_env>_<type>_run<run>_<index>_<writer>[_<time>].parquet``; numbers are padded, never cut."""
    form = f"{directory}/{config.op_env}_{config.file_type_prefix}_{config.run_number_prefix}%0{config.digits_for_run_number}d_%0{config.digits_for_file_index}d_%s"
    name = F.format_string(form, run.cast("long"), index.cast("long"), writer)
    return F.concat(F.concat_ws("_", name, stamp) if stamp is not None else name, F.lit(".parquet"))


def record_path(trigger: Column, sequence: Column, source: Column, config: RunConfig) -> Column:
    """Place of a fragment inside its file."""
    form = f"TriggerRecord%0{config.digits_for_record_number}d.%0{config.digits_for_sequence_number}d/RawData/Source_0x%08x"
    return F.format_string(form, trigger.cast("long"), sequence.cast("long"), source.cast("long"))


def retry_waits(attempts: DataFrame, config: RunConfig) -> DataFrame:
    """attempts: attempt (from 0). The wait before the next: least * factor^attempt, at most the largest, in ms."""
    least = max(config.min_write_retry_ms, 0.001)
    wait = F.least(F.lit(float(least)) * F.pow(F.lit(float(config.write_retry_factor)), F.col("attempt")), F.lit(float(config.max_write_retry_ms)))
    return attempts.withColumn("wait_ms", wait)


def once(slices: DataFrame, written: DataFrame, key: list[str]) -> DataFrame:
    """Slices not written yet: the first of each key, without keys that are there already."""
    return first_rows(slices, key, ["seqno"]).join(written.select(*key), key, "left_anti")

"""Operator 5: packing token pieces into sequences of fixed length, large items matched first.

What a packing needs to know of a piece is its length, and there are only ``capacity`` lengths.  So the
driver plans on the counts of pieces by length: pieces over a third of the capacity go at most two to a
sequence, each with the largest partner that fits (which pairs as many as can be paired); the others go
by falling length where they leave least room.  The plan has stretches of like sequences, not sequences:
its size depends on the capacity, never on the number of documents.  Each piece then finds its place from
its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encoder import encoder, resolve
from ..functions.ranking import grouped_rank
from ..sources.scratch import staged


@dataclass(frozen=True)
class Plan:
    """Stretches: pieces of one length from a rank on, ``each`` to a sequence from sequence ``base``, first at ``offset``."""

    capacity: int
    sequences: int
    length: np.ndarray
    rank: np.ndarray
    base: np.ndarray
    each: np.ndarray
    offset: np.ndarray


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Large-item matching, then best fit by falling length, over counts of pieces by length."""
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("a piece's length must be from 1 to the capacity")
    left = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        left[s] = n
    stretches: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)
    sequences = 0

    def put(s: int, n: int, base: int, each: int, offset: int) -> None:
        stretches.append((s, used[s], base, each, offset))
        used[s] += n

    least = capacity // 3 + 1
    for a in range(capacity, least - 1, -1):
        b = min(a, capacity - a)
        while left[a]:
            while b >= least and not left[b] > (a == b):
                b -= 1
            if b < least:
                put(a, int(left[a]), sequences, 1, 0)
                open_[capacity - a].append((sequences, int(left[a])))
                sequences += int(left[a])
                left[a] = 0
                break
            n = int(left[a] // 2 if a == b else min(left[a], left[b]))
            put(a, n, sequences, 1, 0)
            put(b, n, sequences, 1, a)
            left[a] -= n
            left[b] -= n
            open_[capacity - a - b].append((sequences, n))
            sequences += n
    for s in range(least - 1, 0, -1):
        n, gap = int(left[s]), s
        while n:
            while gap <= capacity and not open_[gap]:
                gap += 1
            if gap > capacity:
                new = -(-n // (capacity // s))
                open_[capacity].append((sequences, new))
                sequences += new
                gap = capacity
            base, many = open_[gap].pop()
            each = gap // s
            full = min(many, n // each)
            if full:
                put(s, full * each, base, each, capacity - gap)
                open_[gap - each * s].append((base, full))
                n -= full * each
            if many > full:
                over = 0
                if 0 < n < each:
                    put(s, n, base + full, n, capacity - gap)
                    open_[gap - n * s].append((base + full, 1))
                    n, over = 0, 1
                if many - full - over:
                    open_[gap].append((base + full + over, many - full - over))
    table = np.array(sorted(stretches), np.int64).reshape(-1, 5)
    return Plan(capacity, sequences, *table.T)


_PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece", T.IntegerType(), False),
            T.StructField("start", T.LongType(), False),
            T.StructField("length", T.LongType(), False),
            T.StructField("ids_crc32", T.LongType(), False),
            T.StructField("ids", T.BinaryType()),
        ]
    )
)


def cut(ids: bytes, capacity: int, with_ids: bool = False) -> list[tuple]:
    """Pieces of a document's ids (32 bits each): whole if it fits, else full pieces after a first one that takes the remainder."""
    n = len(ids) // 4
    first = n if n <= capacity else n % capacity or capacity
    bounds = [0, *range(first, n + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(x := ids[4 * a : 4 * b]), x if with_ids else None) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text", with_ids: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row per piece: key, kept columns, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""
    end = int(end_id).to_bytes(4, "little")

    @F.pandas_udf(_PIECES)
    def cut_texts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(resolve(tokenizer)).encode
        for batch in texts:
            names = ("piece", "start", "length", "ids_crc32", "ids")
            yield pd.Series([[dict(zip(names, p, strict=True)) for p in cut(ids + end, capacity, with_ids)] for ids in encode([x or "" for x in batch])])

    # exploded where it is made: over a column of its own Spark infers a filter on it, which runs the function twice
    rows = docs.select(F.col(key), *(F.col(c) for c in keep or []), F.explode(cut_texts(F.col(text))).alias("p"))
    return rows.select(key, *(keep or []), "p.piece", "p.start", "p.length", "p.ids_crc32", *(["p.ids"] if with_ids else []))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row per piece, with its place: sequence_id (long, from 0) and offset (gapless from 0 in each sequence).

    Null and empty texts are documents of the end id alone; repeated rows are packed each; a null key passes
    through; no rows give no sequences. Columns beyond key, text and ``keep`` are not read; kept columns
    may have any name but those of the result.
    """
    cut_up = staged(pieces(docs, tokenizer, capacity, end_id, key, text, with_ids, keep), "pieces")
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    planned = plan(counts, capacity)
    order = [F.xxhash64(key, "piece", "ids_crc32").alias("_h"), key, "piece", "ids_crc32"]
    ranked = grouped_rank(cut_up.withColumn("_h", order[0]), ["length"], ["_h", *order[1:]], "_rank").drop("_h")
    starts = (planned.length << 40) + planned.rank

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        k = np.searchsorted(starts, (s << 40) + r, "right") - 1
        nth = r - planned.rank[k]
        return pd.DataFrame({"sequence_id": planned.base[k] + nth // planned.each[k], "offset": planned.offset[k] + nth % planned.each[k] * s})

    names = [c for c in ranked.columns if c != "_rank"]
    return ranked.withColumn("_place", place("length", "_rank")).select(*names, "_place.sequence_id", "_place.offset")

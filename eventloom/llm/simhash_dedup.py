"""Operator 9: near-duplicates by SimHash, all links within a Hamming radius of 3.

Fingerprints are 64 bits over 3-word shingles.  The search embeds a fingerprint as the bit counts of its
32 segments of two bits.  The Manhattan distance of two such vectors never exceeds the Hamming distance,
so whatever lies within Hamming distance 3 lies within Manhattan distance 3.  The range join over that
grid: the segments form G groups; vectors within distance 3 agree in at least G - 3 groups, so they meet
in a grid cell given by some G - 3 of the groups.  Within a cell the Manhattan distance goes first, then
the exact Hamming distance.  With six groups (20 cells for each fingerprint, of about 23 bits) chance
meetings are few up to some hundred million fingerprints; eight (56 cells of 28 bits) suit billions.
Every choice finds the same links.

A segment's count (0, 1, 2) is kept as the bits 00, 01, 11 in the segment's place: a cell is then a mask,
and the Manhattan distance is the number of bits in which two codes differ.

Only distinct fingerprints take part, so a group of exact copies is one row.  A cell doesn't emit its
pairs but a spanning forest of its links, which has the same components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from ..sources.scratch import staged
from .text import words

RADIUS = 3
#: Groups of segments; more groups make more but smaller cells.
GROUPS = 6
#: More fingerprints of one cell than this are taken in blocks, block against block.
BLOCK = 4096
_ONE = np.uint64(1)
_LOW = np.uint64(0x5555555555555555)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a whole text. No words: zero. Fewer than ``width`` words: one shingle of all."""
    tokens = words(text.lower() if text else None)
    if not tokens:
        return 0
    n = max(1, len(tokens) - width + 1)
    shingles = map(b" ".join, zip(*(tokens[k:] for k in range(width)))) if len(tokens) >= width else [b" ".join(tokens)]
    hashed = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = hashed[at : at + 65536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.bitwise_or.reduce(np.left_shift((2 * ones > n).astype(np.uint64), np.arange(64, dtype=np.uint64))))


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([_signed(fingerprint(x)) for x in batch], dtype="int64")


def fingerprints(text: Column) -> Column:
    """Fingerprint as a signed long with the same 64 bits."""
    return _fingerprints(text.cast("binary"))


def hex16(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def counts_code(bits: Column) -> Column:
    """The embedding: each two-bit segment's bit count in unary."""
    low = F.lit(0x5555555555555555)
    shifted = F.shiftrightunsigned(bits, 1)
    return bits.bitwiseOR(shifted).bitwiseAND(low).bitwiseOR(F.shiftleft(bits.bitwiseAND(shifted).bitwiseAND(low), 1))


def _counts_code(bits: np.ndarray) -> np.ndarray:
    shifted = bits >> _ONE
    return ((bits | shifted) & _LOW) | ((bits & shifted & _LOW) << _ONE)


def masks(groups: int = GROUPS) -> list[int]:
    """The masks over all but three of the groups, for each choice of the three."""
    if not RADIUS < groups <= 32:
        raise ValueError("groups must be from 4 to 32")
    bounds = [2 * (32 * k // groups) for k in range(groups + 1)]
    bits = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(bounds, bounds[1:])]
    return [_signed(sum(chosen)) for chosen in combinations(bits, groups - RADIUS)]


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of the bit counts as the lower bound, then the exact distance for what passes."""
    ok = np.bitwise_count(_counts_code(a) ^ _counts_code(b)) <= RADIUS
    ok &= np.bitwise_count(a ^ b) <= RADIUS
    return ok


def _forest(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links among distinct fingerprints: at most len(codes) - 1 edges, by breadth-first search."""
    edges, rest = [], codes
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            linked = near(rest, at)
            if linked.any():
                found = rest[linked]
                edges.append((np.full(len(found), at), found))
                queue.extend(found)
                rest = rest[~linked]
    return edges


_LINKS = "a long, b long, table int, cell long, block int"


def _rows(edges: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    a = np.concatenate([x for x, _ in edges]) if edges else np.zeros(0, np.uint64)
    b = np.concatenate([x for _, x in edges]) if edges else np.zeros(0, np.uint64)
    a, b = a.view(np.int64), b.view(np.int64)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "table": np.int32(0), "cell": np.int64(0), "block": np.int32(-1)}).drop_duplicates()


def _in_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links within cells, from rows sorted by table, cell. Blocks of cells over BLOCK rows pass on for a second step."""
    held: list[np.ndarray] = []
    block = 0

    def run(rows: np.ndarray, last: bool) -> Iterator[pd.DataFrame]:
        """rows: one cell's next rows; at most BLOCK wait for more of the same cell."""
        nonlocal held, block
        rows = np.concatenate([*held, rows]) if held else rows
        held = []
        while len(rows) > BLOCK or (last and block and len(rows)):
            part, rows = rows[:BLOCK], rows[BLOCK:]
            yield pd.DataFrame({"a": part[:, 2], "b": np.int64(0), "table": part[:, 0].astype(np.int32), "cell": part[:, 1], "block": np.int32(block)})
            block += 1
        if not last:
            held = [rows]
            return
        block = 0
        if len(rows) > 1:
            yield _rows(_forest(rows[:, 2].view(np.uint64)))

    before = None
    for batch in batches:
        rows = batch[["table", "cell", "a"]].to_numpy(np.int64)
        if not len(rows):
            continue
        change = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
        starts, ends = np.r_[0, change], np.r_[change, len(rows)]
        first = 0
        if before is not None:
            if (rows[0, :2] == before).all():
                yield from run(rows[: ends[0]], len(ends) > 1)
                first = 1
            else:
                yield from run(rows[:0], True)
        inner = slice(first, len(ends) - 1)
        length = ends[inner] - starts[inner]
        codes = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
        at = starts[inner][length == 2]
        ok = near(codes[at], codes[at + 1])
        edges = [(codes[at][ok], codes[at + 1][ok])]
        for k in np.flatnonzero(length > 2):
            lo, hi = starts[inner][k], ends[inner][k]
            if hi - lo > BLOCK:
                yield from run(rows[lo:hi], True)
            else:
                edges += _forest(codes[lo:hi])
        yield _rows(edges)
        if first < len(ends):
            yield from run(rows[starts[-1] :], False)
        before = rows[-1, :2].copy()
    if before is not None:
        yield from run(np.zeros((0, 3), np.int64), True)


def _between_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links within pairs of blocks: rows sorted by table, cell, i, j; a run is at most two blocks."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        key = held[["table", "cell", "i", "j"]].to_numpy(np.int64)
        last = np.flatnonzero((key != key[-1]).any(1))
        cut = last[-1] + 1 if len(last) else 0
        done, held = held[:cut], held[cut:]
        for _, g in done.groupby(["table", "cell", "i", "j"], sort=False):
            yield _rows(_forest(np.unique(g["a"].to_numpy(np.int64)).view(np.uint64)))
    if held is not None and len(held):
        yield _rows(_forest(np.unique(held["a"].to_numpy(np.int64)).view(np.uint64)))


def links(codes: DataFrame, groups: int = GROUPS) -> DataFrame:
    """codes: distinct fingerprints as the long column ``code``. Result: a, b long, a < b.

    A spanning set of all links within the radius: each fingerprint pair at distance 3 or less is linked
    directly or through others, and every row is a true link.  Cost follows the rows of the cells, and
    the square of a cell's size only in comparisons inside a task of at most two blocks.
    """
    code = F.col("code")
    embedded = counts_code(code)
    tables = F.array(*[F.struct(F.lit(t).alias("table"), embedded.bitwiseAND(F.lit(m)).alias("cell")) for t, m in enumerate(masks(groups))])
    cells = codes.select(code.alias("a"), F.explode(tables).alias("t")).select("t.table", "t.cell", "a")
    cells = cells.repartition("table", "cell").sortWithinPartitions("table", "cell")
    found = staged(cells.mapInPandas(_in_cells, _LINKS), "links")
    large = found.where("block >= 0")
    out = found.where("block < 0").select("a", "b")
    if not large.isEmpty():
        sizes = large.groupBy("table", "cell").agg((F.max("block") + 1).alias("blocks"))
        pairs = large.join(sizes, ["table", "cell"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = pairs.select("table", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "a")
        pairs = pairs.repartition("table", "cell", "i", "j").sortWithinPartitions("table", "cell", "i", "j")
        out = out.unionByName(pairs.mapInPandas(_between_blocks, _LINKS).select("a", "b"))
    return out.distinct()


def classes(marked: DataFrame, least: str, groups: int = GROUPS) -> DataFrame:
    """marked: a table with ``code`` and the order column ``least``. Result: code, class_least (of all rows of its class).

    ``marked`` is read twice; hand in a table that is cheap to read.
    """
    each = staged(marked.groupBy("code").agg(F.min(least).alias("least")), "codes")
    found = components(links(each.select("code"), groups))
    named = each.join(found, each["code"] == found["node"], "left").select("code", F.coalesce("component", "code").alias("_class"), "least")
    of = named.groupBy("_class").agg(F.min("least").alias("class_least"))
    return named.join(of, "_class").select("code", "class_least")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: int = GROUPS) -> DataFrame:
    """One row per row of docs: key, code (signed long), fingerprint (16 hex digits), component_id.

    component_id is the smallest key reachable over links; null only if no row of the class has a key. Null
    and empty texts have no words: fingerprint zero, linked like any other. Repeated rows share their
    class. An empty table gives an empty result. Only key and text are read.
    """
    marked = staged(docs.select(F.col(key).alias("_key"), fingerprints(F.col(text)).alias("code")), "fingerprints")
    out = marked.join(classes(marked, "_key", groups), "code")
    return out.select(F.col("_key").alias(key), "code", hex16(F.col("code")).alias("fingerprint"), F.col("class_least").alias("component_id"))


#: Words of 64 parity bits of a text's shingles.
PARITY = 8


def shingle_set(text: bytes | None, width: int) -> set[bytes]:
    """Distinct shingles of ``width`` words, A-Z in lower case; fewer words make one shingle, none makes none."""
    tokens = words(text.lower() if text else None)
    if len(tokens) < width:
        return {b" ".join(tokens)} if tokens else set()
    return set(map(b" ".join, zip(*(tokens[k:] for k in range(width)))))


def similarity(a: set[bytes], b: set[bytes]) -> float:
    """Jaccard similarity; texts without words are alike."""
    return len(a & b) / len(a | b) if a or b else 1.0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _most_apart(size: float, other: float, least: float) -> int:
    """The largest number of shingles in one of two sets only, at a similarity of ``least`` or more: never too small."""
    return int((size + other) * (1 - least) / (1 + least) + 1e-6)


def cells(hashed: np.ndarray, least: float) -> np.ndarray:
    """Cells of a set of distinct hashes: any two sets with a similarity of ``least`` (over 0, up to 1) or more share one.

    Sizes have classes that double.  A class cuts its sets by hash into more parts than hashes of two alike sets can
    differ, so alike sets have whole parts in common, at least (parts with something in them) - (hashes that may differ).
    So if each takes one part more than may differ, in one order for all (parts with the most hashes first, which are met by chance
    least), they share one of these.  A set also takes the parts of larger classes in which sets alike to it may be.  A
    set with too few parts takes them all and its least single hashes, by the same count; two such sets share one of those.
    """
    n = len(hashed)
    if not n:
        return np.array([0], np.uint64)
    out = []
    klass = n.bit_length() - 1
    own = klass
    with np.errstate(over="ignore"):
        while klass == own or (1 << klass) * least <= n + 1e-6:
            top = (2 << klass) - 1
            most = _most_apart(top, top, least)
            parts = most + 1 + most // 6
            tag = _mixed(np.array([(klass << 32) + 7], np.uint64))[0]
            mixed = _mixed(hashed ^ tag)
            part = (mixed % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ids = part[order]
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            many = np.diff(np.r_[starts, n])
            content = np.add.reduceat(_mixed(mixed[order] + tag), starts)
            tokens = _mixed(content ^ _mixed(ids[starts].astype(np.uint64) + tag))
            apart = _most_apart(n, min(n / least, top), least)
            out.append(tokens[np.lexsort((tokens, -many))][: apart + 1])
            if len(tokens) <= apart:
                single = np.sort(mixed)
                out.append(_mixed(single[: n - int(np.ceil(least * n - 1e-6)) + 1] + np.uint64(1)))
            klass += 1
    return np.unique(np.concatenate(out))


def parity(hashed: np.ndarray) -> np.ndarray:
    """Bits of how many hashes fall on each, odd or even: two sets' bits differ in no more places than the sets in hashes."""
    odd = np.bincount((_mixed(hashed) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sketch(text: bytes | None, width: int, least: float) -> tuple[int, int, int, list[int], list[int]]:
    """Fingerprint over shingles, a hash of the set of shingles, its size, parity bits, and the cells of the wide search."""
    own = shingle_set(text, width)
    hashed = np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in own), np.uint64, len(own)))
    with np.errstate(over="ignore"):
        whole = np.bitwise_xor.reduce(hashed) + hashed.sum(dtype=np.uint64) * np.uint64(3) if own else np.uint64(0)
        bits = parity(hashed)
    return _signed(fingerprint(text, width)), int(np.uint64(whole).view(np.int64)), len(hashed), bits.tolist(), cells(hashed, least).view(np.int64).tolist()


_SKETCH = T.StructType([T.StructField("code", T.LongType()), T.StructField("whole", T.LongType()), T.StructField("size", T.LongType()), T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("cells", T.ArrayType(T.LongType()))])


def _sketches(width: int, least: float):
    @F.pandas_udf(_SKETCH)
    def each(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([_sketch(x, width, least) for x in batch], columns=_SKETCH.names)

    return each


def shared_cells(marked: DataFrame) -> DataFrame:
    """marked: whole, size, bits, cells. Rows cell, whole, size, bits, n: the distinct texts of every cell with more than one (n of them)."""
    rows = marked.select("whole", F.explode("cells").alias("cell")).repartition("cell").dropDuplicates(["cell", "whole"])
    met = rows.withColumn("n", F.count("*").over(Window.partitionBy("cell"))).where("n > 1")
    texts = marked.groupBy("whole").agg(F.first("size").alias("size"), F.first("bits").alias("bits"))
    return staged(met.join(texts, "whole"), "cells")


def wide_pairs(shared: DataFrame) -> DataFrame:
    """The first pairs (a, b): every text with the one of its cell that shares most with all others, which the rest was likely copied from."""
    weighed = shared.select("cell", "whole", "n").join(shared.groupBy("whole").agg(F.sum("n").alias("w")), "whole")
    heads = weighed.groupBy("cell").agg(F.max(F.struct("w", "whole")).alias("most")).select("cell", F.col("most.whole").alias("head"))
    met = shared.select("cell", "whole").join(heads, "cell").where("whole <> head")
    return met.select(F.least("whole", "head").alias("a"), F.greatest("whole", "head").alias("b")).distinct()


def other_pairs(shared: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of a cell that no link joins yet (found: node, component), without those that sizes or parity bits rule out.

    Together with what ``found`` joins these are all pairs of a cell whose similarity may be ``least`` or more.
    """
    named = shared.join(found, shared["whole"] == found["node"], "left").select("cell", "whole", "size", "bits", F.coalesce("component", "whole").alias("of"))
    open_ = named.groupBy("cell").agg(F.min("of").alias("_x"), F.max("of").alias("_y")).where("_x <> _y").select("cell")
    named = named.join(open_, "cell")
    a, b = (named.select("cell", *[F.col(c).alias(f"{c}_{x}") for c in ("whole", "size", "bits", "of")]) for x in "ab")
    apart = sum((F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(PARITY)), F.lit(0))
    may = (F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - 1e-6) & (apart <= (F.col("size_a") + F.col("size_b")) * ((1 - least) / (1 + least)) + 1e-6)
    met = a.join(b, "cell").where((F.col("whole_a") < F.col("whole_b")) & (F.col("of_a") != F.col("of_b")) & may)
    return met.select(F.col("whole_a").alias("a"), F.col("whole_b").alias("b")).distinct()


def alike(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts (whole, text) have an exact shingle similarity of ``least`` or more."""

    @F.pandas_udf(T.BooleanType())
    def check(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            seen: tuple[bytes | None, set[bytes]] = (None, set())
            out = []
            for x, y in zip(left, right):
                if y is None or y != seen[0]:
                    seen = (y, shingle_set(y, width))
                out.append(similarity(shingle_set(x, width), seen[1]) >= least)
            yield pd.Series(out, dtype=bool)

    a, b = (texts.select(F.col("whole").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").where(check("text_a", "text_b")).select("a", "b")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: int = GROUPS, width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs with all columns, one of each class of near-duplicates: the smallest key (null keys last), then the smallest row hash.

    Near-duplicates are texts whose shingles of ``width`` words have a Jaccard similarity of ``least`` or more, and what links
    over such pairs.  Candidates are the links of the fingerprint grid, and all texts that share a cell of ``cells``,
    as any two that are so alike do: at a similarity of 0.8 fingerprints lie about ten bits apart, where no grid filters.  Every
    candidate is verified on whole texts, but for pairs that verified links join already.  Texts with the same set of shingles are one from the start, those without words too.
    Rows that agree in every column are one row afterwards; map columns must not occur. Column names that begin with ``_dedup`` are taken.
    """
    columns = [f"`{c}`" for c in docs.columns]
    row = F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])
    names = ["_dedup_n", "_dedup_k", "_dedup_r"]
    named = dict(zip(names, (F.col(f"`{key}`").isNull(), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), row)))
    rank = F.struct(F.col(f"`{key}`").isNull().alias("n"), F.col(f"`{key}`").alias("k"), row.alias("r"))
    marked = staged(docs.select(rank.alias("rank"), _sketches(width, least)(F.col(f"`{text}`").cast("binary")).alias("s")).select("rank", "s.*"), "sketches")
    each = staged(marked.groupBy("whole").agg(F.min("rank").alias("least"), F.first("code").alias("code")), "texts")
    by_code = each.groupBy("code").agg(F.min("whole").alias("head"))
    same = each.join(by_code, "code").where("whole <> head").select(F.least("whole", "head").alias("a"), F.greatest("whole", "head").alias("b"))
    near_codes = links(by_code.select("code"), groups).join(by_code.select(F.col("code").alias("a"), F.col("head").alias("ha")), "a").join(by_code.select(F.col("code").alias("b"), F.col("head").alias("hb")), "b")
    near_codes = near_codes.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    own = docs.select(*[c.alias(n) for n, c in named.items()], F.col(f"`{text}`").cast("binary").alias("text"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs, "pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("whole")).distinct()
        wanted = each.join(wanted, "whole").select("whole", F.col("least.n").alias(names[0]), F.coalesce(F.col("least.k").cast("string"), F.lit("")).alias(names[1]), F.col("least.r").alias(names[2]))
        texts = own.join(wanted, names).groupBy("whole").agg(F.first("text").alias("text"))
        return staged(alike(pairs, texts, width, least), "links")

    shared = shared_cells(marked)
    linked = verified(wide_pairs(shared).unionByName(same).unionByName(near_codes).distinct())
    # what shares a cell and isn't joined by these links is compared pair by pair
    found = components(linked.unionByName(verified(other_pairs(shared, components(linked), least))))
    kept = each.join(found, each["whole"] == found["node"], "left").groupBy(F.coalesce("component", "whole").alias("_class")).agg(F.min("least").alias("l")).select("l.*")
    kept = kept.select(F.col("n").alias(names[0]), F.coalesce(F.col("k").cast("string"), F.lit("")).alias(names[1]), F.col("r").alias(names[2]))
    return docs.withColumns(named).join(kept, names, "left_semi").dropDuplicates(names).drop(*names)

"""Operator 8: benchmark items inside documents.

A document's windows of an item's own size are compared with the item.  SimHash fingerprints of windows
look up the items of their size in a multi-index: fingerprints within 23 bits of each other agree to 2 bits in at
least one of eight 8-bit blocks, and each block's table holds, for each of its 256 values, which items are within 2
bits, as one bit an item; so no fingerprint within the radius is missed, and an item takes 256 bytes.  Candidates are
verified by the exact weighted Jaccard similarity of their 5-word shingles (counts times the shingle's rarity among
all distinct items).

A window that shares no shingle with an item has similarity zero; fingerprints are made only for windows
that share one.  Whole texts are searched, document by document, so no group of any size meets in a task.
Equal items are searched once.  A benchmark over ``PASS_BYTES`` takes several passes over the documents, split by
item size, with the weights of the whole benchmark in each, so results are the same in one pass or many.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import staged

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 23
_BLOCKS = 8
_BLOCK_RADIUS = RADIUS // _BLOCKS
#: Bytes of item text that one pass over the documents holds in memory; more items take more passes.
PASS_BYTES = 4_000_000
#: Shingles that several items share are sent to tasks with their weights; more of them than this are refused, not cut.
MOST_SHARED = 4_000_000

_PLAIN = bytes(x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))
_BITS = np.arange(64, dtype=np.uint64)


def plain_words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII bytes, A-Z in lower case: punctuation and case make no difference."""
    return text.lower().translate(_PLAIN).split() if text else []


class Index:
    """Items, their shingles and fingerprints. Built from (number, words) pairs once in each worker.

    ``n`` distinct items and ``shared`` (hash of a shingle -> how many of them have it, for those of two or more) are of the
    whole benchmark; without them the items given are all there is.
    """

    def __init__(self, items: tuple[tuple[int, tuple[bytes, ...]], ...], n: int | None = None, shared: tuple[tuple[int, int], ...] | None = None):
        self.words: dict[bytes, int] = {}
        self.items = [(number, tokens) for number, tokens in items if tokens]
        for _, tokens in self.items:
            for w in tokens:
                self.words.setdefault(w, len(self.words) + 1)
        self.widths = sorted({min(WIDTH, len(t)) for _, t in self.items})
        self.size = np.array([len(t) for _, t in self.items], np.int64)
        rarity: Counter = Counter()
        grams = []
        for _, tokens in self.items:
            own = self._grams(list(tokens), min(WIDTH, len(tokens)))
            grams.append(own)
            rarity.update(set(own))
        self.gram_id = {g: k for k, g in enumerate(sorted(rarity))}
        n = max(1, len(self.items) if n is None else n)
        if shared is not None:
            among = dict(shared)
            rarity = Counter({g: among.get(_gram_hash(g), 1) for g in rarity})
            own = {_gram_hash(g) for g in rarity}
            #: Shared shingles that none of these items has: they weigh what they weigh in the whole benchmark.
            self.foreign = {h: float(np.log1p(n / c)) for h, c in shared if h not in own}
        else:
            self.foreign = {}
        #: The last entry is for shingles that no item has.
        self.weight = np.array([np.log1p(n / rarity[g]) for g in self.gram_id] + [np.log1p(n)])
        hashed = np.array([xxhash.xxh64_intdigest(b" ".join(g)) for g in self.gram_id] + [0], np.uint64)
        #: A shingle that no item has pulls no bit: it can't be shared, so it would only blur the look-up.
        self.signs = np.where((hashed[:, None] >> _BITS) & np.uint64(1) == 1, self.weight[:, None], -self.weight[:, None])
        self.signs[-1] = 0
        self.grams = [Counter(self.gram_id[g] for g in own) for own in grams]
        self.total = np.array([sum(self.weight[g] * c for g, c in own.items()) for own in self.grams])
        self.prints = np.array([self._print(sum(self.signs[g] * c for g, c in own.items())) for own in self.grams], np.uint64)
        self.having: dict[int, list[int]] = defaultdict(list)
        for k, own in enumerate(self.grams):
            for g in own:
                self.having[g].append(k)
        self.codes = {w: self._codes(w) for w in self.widths}
        #: By size: the items of that size, their shingles, and for each block and value which of them are near, as bits.
        self.of_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == size)
            grams = np.unique(np.concatenate([np.fromiter(self.grams[k], np.int64) for k in own]))
            self.of_size[size] = own, grams, self._near(self.prints[own])

    @staticmethod
    def _grams(tokens: list[bytes], width: int) -> list[tuple[bytes, ...]]:
        return list(zip(*(tokens[k:] for k in range(width))))

    @staticmethod
    def _print(sums: np.ndarray) -> np.uint64:
        return np.bitwise_or.reduce((sums > 0).astype(np.uint64) << _BITS)

    def _codes(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted codes of the items' shingles of this width, and their ids."""
        own = [(self._code(np.array([[self.words[w] for w in g]]))[0], k) for g, k in self.gram_id.items() if len(g) == width]
        own.sort()
        return np.array([c for c, _ in own], np.uint64), np.array([k for _, k in own], np.int64)

    @staticmethod
    def _code(ids: np.ndarray) -> np.ndarray:
        """Exact for up to 2^12 words at five a shingle; beyond that a 64-bit hash, verified by the words themselves."""
        with np.errstate(over="ignore"):
            return reduce(lambda a, b: a * np.uint64(0x9E3779B97F4A7C15) + b, ids.astype(np.uint64).T)

    @staticmethod
    def _near(prints: np.ndarray) -> np.ndarray:
        """[block, value, items / 8]: bits of the items whose block is within the block radius of the value."""
        values = np.arange(256, dtype=np.uint8)
        blocks = prints.astype("<u8").view(np.uint8).reshape(-1, _BLOCKS)
        out = np.zeros((_BLOCKS, 256, -(-len(prints) // 8)), np.uint8)
        for b in range(_BLOCKS):
            out[b] = np.packbits(np.bitwise_count(values[:, None] ^ blocks[None, :, b]) <= _BLOCK_RADIUS, axis=1)
        return out

    def within(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in prints, item of this size) within the radius, by the multi-index."""
        own, _, near = self.of_size[size]
        blocks = np.ascontiguousarray(prints.astype("<u8")).view(np.uint8).reshape(-1, _BLOCKS)
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        step = max(1, 4_000_000 // len(own))
        for lo in range(0, len(prints), step):
            part = blocks[lo : lo + step]
            hit = near[0][part[:, 0]]
            for b in range(1, _BLOCKS):
                hit |= near[b][part[:, b]]
            at, item = np.nonzero(np.unpackbits(hit, axis=1, count=len(own)))
            ok = np.bitwise_count(prints[lo + at] ^ self.prints[own[item]]) <= RADIUS
            pairs.append((lo + at[ok], own[item[ok]]))
        return np.concatenate([x for x, _ in pairs]), np.concatenate([x for _, x in pairs])

    def shingles(self, tokens: list[bytes], width: int) -> np.ndarray | None:
        """Shingle ids by position, the unknown id where no item has the shingle; None if none has any."""
        ids = np.array(list(map(self.words.get, tokens, (0,) * len(tokens))), np.int64)
        n = len(ids) - width + 1
        if n < 1:
            return None
        known = ids > 0
        run = known[:n].copy()
        for k in range(1, width):
            run &= known[k : k + n]
        at = np.flatnonzero(run)
        codes, numbers = self.codes[width]
        if not len(at):
            return None
        own = self._code(np.stack([ids[at + k] for k in range(width)], 1))
        place = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        ok = codes[place] == own
        out = np.full(n, len(self.gram_id), np.int64)
        for p, k in zip(at[ok], numbers[place[ok]]):
            if self.gram_id.get(tuple(tokens[p : p + width])) == k:
                out[p] = k
        return out if (out < len(self.gram_id)).any() else None

    def search(self, text: bytes | None, threshold: float = SIMILARITY) -> list[tuple[int, float, int, int]]:
        """(item number, similarity, first word, words) of each item's best window at or over the threshold."""
        tokens = plain_words(text)
        best: dict[int, tuple[float, int]] = {}
        for width in self.widths:
            found = self.shingles(tokens, width)
            if found is None:
                continue
            windows: dict[int, set[int]] = defaultdict(set)
            for p in np.flatnonzero(found < len(self.gram_id)).tolist():
                for size in {int(self.size[k]) for k in self.having[int(found[p])]}:
                    if min(WIDTH, size) == width:
                        windows[size].update(range(max(0, p - size + width), min(p, max(0, len(tokens) - size)) + 1))
            for size, starts in windows.items():
                self._windows(tokens, found, size, width, np.array(sorted(starts), np.int64), threshold, best)
        return [(self.items[k][0], s, at, int(min(self.size[k], len(tokens)))) for k, (s, at) in sorted(best.items())]

    def _weights(self, tokens: list[bytes], found: np.ndarray, used: np.ndarray, width: int) -> np.ndarray:
        """Weights of the shingles at these places."""
        out = self.weight[found[used]]
        if self.foreign:
            unknown = len(self.gram_id)
            for k, p in enumerate(used.tolist()):
                if found[p] == unknown:
                    out[k] = self.foreign.get(_gram_hash(tokens[p : p + width]), out[k])
        return out

    def _windows(self, tokens: list[bytes], found: np.ndarray, size: int, width: int, starts: np.ndarray, threshold: float, best: dict) -> None:
        """Fingerprints the windows at ``starts``, some thousands at a time, and verifies their candidates.

        Only shingles of items of this size pull bits of a fingerprint.
        """
        many = size - width + 1
        grams = self.of_size[size][1]
        for part in np.array_split(starts, -(-len(starts) // 2048)):
            lo, hi = int(part[0]), min(len(found), int(part[-1]) + many)
            used = np.unique((part[:, None] + np.arange(many)).ravel())
            used = used[used < hi]
            own = found[used]
            sums = np.zeros((len(used) + 1, 64))
            np.cumsum(self.signs[np.where(np.isin(own, grams), own, len(self.gram_id))], 0, out=sums[1:])
            weights = np.r_[0, np.cumsum(self._weights(tokens, found, used, width))]
            first, last = np.searchsorted(used, part), np.searchsorted(used, np.minimum(part + many, hi))
            prints = np.bitwise_or.reduce((sums[last] - sums[first] > 0).astype(np.uint64) << _BITS, axis=1)
            for at, item in zip(*self.within(prints, size)):
                start = int(part[at])
                grams_of = self.grams[item]
                there = Counter(found[start : start + many].tolist())
                shared = sum(self.weight[g] * min(c, there[g]) for g, c in grams_of.items() if g in there)
                total = weights[last[at]] - weights[first[at]] + self.total[item] - shared
                similarity = shared / total if total else 0.0
                if similarity >= threshold - 1e-9 and (item not in best or (similarity, -start) > (best[item][0], -best[item][1])):
                    best[int(item)] = (float(similarity), start)


def _gram_hash(gram) -> int:
    return xxhash.xxh64_intdigest(b" ".join(gram))


@lru_cache(maxsize=2)
def _index(items: tuple, n: int, shared: tuple) -> Index:
    return Index(items, n, shared)


_GRAMS = T.ArrayType(T.LongType())


@F.pandas_udf(T.StructType([T.StructField("words", T.StringType()), T.StructField("size", T.LongType()), T.StructField("grams", _GRAMS)]))
def _taken_apart(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for x in batch:
            tokens = plain_words(x)
            own = {_gram_hash(g) for g in Index._grams(tokens, min(WIDTH, len(tokens)))} if tokens else set()
            rows.append((b" ".join(tokens).decode("utf-8", "replace"), len(tokens), sorted(h - (1 << 64) if h >= 1 << 63 else h for h in own)))
        yield pd.DataFrame(rows, columns=["words", "size", "grams"])


class Passes:
    """A benchmark made ready: its distinct items, the weights of all, and how many passes they take.

    Items are told apart by their words.  A pass holds the items of some sizes, and at most about ``PASS_BYTES`` of their text; only
    where the items of one size are more than that is a size split.
    """

    def __init__(self, items: DataFrame, item: str, text: str):
        rows = items.select(F.col(item).alias("item"), F.col(text).cast("binary").alias("text")).where("text is not null")
        self.all = staged(rows.select("item", _taken_apart("text").alias("w")).select("item", "w.*").where("size > 0"), "items")
        distinct = self.all.groupBy("words", "size").agg(F.first("grams").alias("grams")).withColumn("bytes", F.octet_length("words"))
        self.distinct = staged(distinct.withColumn("at", F.xxhash64("words")), "distinct")
        self.n = self.distinct.count()
        shared = self.distinct.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
        if (many := shared.count()) > MOST_SHARED:
            raise ValueError(f"{many} shingles are shared by items; the bound is {MOST_SHARED}")
        self.shared = tuple(sorted((r["g"] % (1 << 64), r["n"]) for r in shared.collect()))
        sizes = sorted((r["size"], r["b"]) for r in self.distinct.groupBy("size").agg(F.sum("bytes").alias("b")).collect())
        self.plan: list[tuple[list[int], int]] = []
        held = 0
        for size, b in sizes:
            parts = -(-int(b) // PASS_BYTES)
            if parts > 1 or not self.plan or self.plan[-1][1] > 1 or held + b > PASS_BYTES:
                self.plan.append(([size], parts))
                held = b
            else:
                self.plan[-1][0].append(size)
                held += b

    def __iter__(self) -> Iterator[tuple]:
        """Each pass's items as (number, words); the number is the hash of the words."""
        for sizes, parts in self.plan:
            own = self.distinct.where(F.col("size").isin(sizes)).select("at", "words")
            for k in range(parts):
                got = own.where(F.pmod("at", F.lit(parts)) == k) if parts > 1 else own
                yield tuple(sorted((r["at"], tuple(r["words"].encode().split())) for r in got.collect()))

    def names(self) -> DataFrame:
        return self.all.select(F.xxhash64("words").alias("at"), "item")


_FOUND = T.StructType([T.StructField("at", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])


def _searching(items: tuple, passes: Passes, threshold: float, flag: bool):
    """A column function over binary texts: all hits, or only whether there is one."""
    n, shared = passes.n, passes.shared

    def each(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _index(items, n, shared)
        for batch in texts:
            found = [index.search(x, threshold) for x in batch]
            yield pd.Series([bool(x) for x in found] if flag else [[dict(zip(_FOUND.names, h)) for h in x] for x in found])

    each.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(each, T.BooleanType() if flag else T.ArrayType(_FOUND))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per document and item found in it: key, item, similarity, first_word, n_words of the best window.

    Words are runs of letters and digits in any case.  Null and empty texts and items have no words and match
    nothing; items under five words are one shingle; a text shorter than an item is one window; ties go to
    the first window; items of equal words are all found where one is; repeated rows give rows each; null keys pass
    through; an empty table on either side gives an empty result. Only the columns named are read.
    """
    passes = Passes(benchmark, item, item_text)
    hits = None
    for items in passes:
        search = _searching(items, passes, threshold, False)
        found = docs.select(F.col(key), F.explode(search(F.col(text).cast("binary"))).alias("hit")).select(F.col(key).alias("_key"), "hit.*")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = docs.sparkSession.createDataFrame([], T.StructType([T.StructField("_key", docs.schema[key].dataType), *_FOUND]))
    return hits.join(passes.names(), "at").select(F.col("_key").alias(key), F.col("item").alias(item), "similarity", "first_word", "n_words")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all columns, in which no item is found."""
    passes = Passes(benchmark, item, item_text)
    for items in passes:
        docs = docs.where(~_searching(items, passes, threshold, True)(F.col(text).cast("binary")))
    return docs

"""Operator 10: language-model scores from a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(class | context) * P(word | class, context).  The most frequent training words make
classes of 64; all other words share classes by their last two letters, within which a word has its
smoothed share of the class's training tokens.  Features of a context are its last word, its last two
(an n-gram, hashed), and the word before the last (a skip feature); a word that has no place of its own
stands for its class.  Both softmaxes start at the training frequencies and learn what the context adds.

Training: rounds of gradient updates.  Training documents are dealt to ``rounds`` groups by a hash of their key and text.
In a round, tasks count over the group how often each feature met each outcome and how often the model
expects it; the counts are summed in a tree, and their difference, scaled by what is expected, is the step.  Sums don't
depend on how the table is cut, so neither do scores, but for rounding.

What the model learns grows with the corpus: the number of hashed rows with the cube root of the training tokens, the
number of classes with their sixth root, and counts of all words meet the documents in a join.  Sent to tasks are
the weights, and the ``frequent`` words with their counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import staged

#: Token of a text's end; no word has a space.
END = " "
_TRIM = ".,;:!?"
#: So many tasks' changes of a block are summed at once, in as many levels as it takes.
FAN_IN = 64


@dataclass(frozen=True)
class Settings:
    """frequent: words sent to tasks. classes of ``members`` words each, and ``tails`` classes for the rest.

    pairs and inner are the hashed rows of word pairs, and of features within a class.  Sizes that are None follow from the
    number of training tokens.  ``shy``: what a row's outcome must be met more often than expected to count half.
    """

    frequent: int = 1 << 17
    classes: int | None = None
    members: int = 64
    tails: int = 32
    pairs: int | None = None
    inner: int | None = None
    rounds: int = 4
    shy: float = 1.0
    step: int = 8192
    block: int = 256

    def sized(self, tokens: int) -> Settings:
        """The same with all sizes for so many training tokens."""
        rows = max(64, round(17 * tokens ** (1 / 3)))
        classes = max(4, round(2 * tokens ** (1 / 6)))
        pick = lambda given, own: own if given is None else given
        return replace(self, classes=pick(self.classes, classes), pairs=pick(self.pairs, rows), inner=pick(self.inner, 2 * rows))

    @property
    def own(self) -> int:
        return self.classes * self.members

    @property
    def contexts(self) -> int:
        """Values of a context word: own words, tails, and a text's start."""
        return self.own + self.tails + 1

    def shapes(self) -> tuple[tuple[int, int], tuple[int, int]]:
        return (2 * self.contexts + self.pairs, self.classes + self.tails), (self.inner, self.members)


def tail_of(word: str, tails: int) -> int:
    return zlib.crc32(word.rstrip(_TRIM)[-2:].encode()) % tails


def _tails(words: pa.Array, tails: int) -> np.ndarray:
    """tail_of for an array of words: the few distinct endings are hashed once."""
    ends = pc.utf8_slice_codeunits(pc.utf8_rtrim(words, characters=_TRIM), -2).dictionary_encode()
    of = np.array([zlib.crc32(e.encode()) % tails for e in ends.dictionary.to_pylist()] or [0], np.int64)
    return of[ends.indices.to_numpy(zero_copy_only=False)]


def tail_column(word: Column, tails: int) -> Column:
    return F.pmod(F.crc32(F.substring(F.rtrim(word, F.lit(_TRIM)), -2, 2)), F.lit(tails)).cast("int")


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(5)) == 1


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Bounds of each text in the tokens (without ends), the distinct words, and each token's number among them."""
    units = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    bounds = units.offsets.to_numpy()
    coded = units.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = (bounds - bounds[0]).astype(np.int64)
    blank = pc.index_in(pa.scalar("", coded.dictionary.type), coded.dictionary).as_py()
    if blank is not None:
        real = index != blank
        bounds = np.r_[0, np.cumsum(real)][bounds]
        index = index[real]
    return bounds, coded.dictionary, index


def count_words(docs: DataFrame, settings: Settings) -> DataFrame:
    """docs: train (boolean), text. Result, written: word, trained, seen (in all documents), the end token among them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, names, index = _tokens(batch.column(1))
            train = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds))
            seen = np.bincount(index, minlength=len(names))
            trained = np.bincount(index[train], minlength=len(names))
            there = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(there)).cast(pa.string()), pa.array(trained[there]), pa.array(seen[there])], names=["word", "trained", "seen"])
            n = int(batch.column(0).to_numpy(zero_copy_only=False).astype(bool).sum())
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([n]), pa.array([batch.num_rows])], names=["word", "trained", "seen"])

    counted = docs.select("train", "text").mapInArrow(count, "word string, trained long, seen long")
    return staged(counted.groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("seen").alias("seen")), "words")


class Lexicon:
    """The frequent words and what is known of them; built by the driver, used in tasks. Fixed size."""

    def __init__(self, settings: Settings, rows: list[tuple[str, int]], total: int, distinct: int, tails: dict[int, tuple[int, int]]):
        """rows: frequent words and their training counts. tails: training tokens and distinct words outside the own classes by tail."""
        s = self.settings = settings
        best = self.best(rows, s)
        self.words = pa.array([w for w, _ in rows], pa.large_string())
        self.count = np.array([c for _, c in rows] or [0], np.float64)
        self.total, self.distinct = total, distinct
        place = {w: k for k, (w, _) in enumerate(best)}
        #: Place among the own words, or own + tail.
        self.place = np.array([place.get(w, s.own + tail_of(w, s.tails)) for w, _ in rows] or [0], np.int64)
        mass = np.zeros(s.classes + s.tails)
        inner = np.full((s.classes, s.members), -np.inf, np.float32)
        for k, (_, c) in enumerate(best):
            mass[k // s.members] += c
            inner[k // s.members, k % s.members] = np.log(c)
        self.tail_total, self.tail_distinct = np.zeros(s.tails), np.zeros(s.tails)
        for t, (c, v) in tails.items():
            self.tail_total[t], self.tail_distinct[t] = c, v
        mass[s.classes :] = self.tail_total + 0.5 * (self.tail_distinct + 1)
        empty = mass == 0
        self.outer_bias = np.where(empty, -np.inf, np.log(np.maximum(mass, 1e-9))).astype(np.float32)
        self.inner_bias = inner

    @staticmethod
    def best(rows: list[tuple[str, int]], settings: Settings) -> list[tuple[str, int]]:
        """The words with a place of their own: those most seen in training."""
        return sorted((r for r in rows if r[1] > 0), key=lambda r: (-r[1], r[0]))[: settings.own]

    def log_base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def in_tail(self, tail: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tail_total[tail] + 0.5 * (self.tail_distinct[tail] + 1)))

    def places(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct words: number among the frequent ones (else -1), and place."""
        number = pc.fill_null(pc.index_in(names, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        place = self.place[number]
        rare = np.flatnonzero(number < 0)
        place[rare] = self.settings.own + _tails(names.take(pa.array(rare)), self.settings.tails)
        return number, place


def _mix(x: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(32)) % np.uint64(size)).astype(np.int64)


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values. Short runs are added place by place, long ones each at once."""
    order = np.argsort(rows.astype(np.uint16) if rows.max(initial=0) < 1 << 16 else rows, kind="stable")
    own, values = rows[order], values.take(order, 0)
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    many = np.diff(np.r_[starts, len(own)])
    sums = values.take(starts, 0)
    for k in range(1, 4):
        more = np.flatnonzero((many > k) & (many <= 4))
        sums[more] += values.take(starts[more] + k, 0)
    for k in np.flatnonzero(many > 4).tolist():
        sums[k] = values[starts[k] : starts[k] + many[k]].sum(0)
    return own[starts], sums


class Model:
    """Weights, and the forward and backward passes over batches of tokens."""

    def __init__(self, lexicon: Lexicon, weights: tuple[np.ndarray, np.ndarray]):
        self.lexicon, self.weights = lexicon, weights
        #: By table: how often the model expects each outcome at each row, and how often it was met.
        self.expected = self.met = None

    def learn(self) -> None:
        """From now on ``run`` counts."""
        self.expected = [np.zeros_like(w) for w in self.weights]
        self.met = [np.zeros_like(w) for w in self.weights]

    def batch(self, texts: pa.Array) -> tuple:
        """Token stream of whole texts with ends: bounds, distinct words (the end last), each one's number, each token's word, place and features."""
        s = self.lexicon.settings
        bounds, dictionary, index = _tokens(texts)
        names = pa.concat_arrays([dictionary.cast(pa.large_string()), pa.array([END], pa.large_string())])
        number, place = self.lexicon.places(names)
        n, docs = len(index), len(bounds) - 1
        ends = bounds[1:] + np.arange(docs)
        stream = np.full(n + docs, len(names) - 1, np.int64)
        word = np.ones(n + docs, bool)
        word[ends] = False
        stream[word] = index
        bounds = np.r_[0, ends + 1]
        at = place[stream]
        start = s.contexts - 1
        last, skip = np.r_[start, at[:-1]], np.r_[start, start, at[:-2]][: len(at)]
        first = bounds[:-1]
        last[first] = start
        skip[first] = start
        second = first[np.diff(bounds) > 1] + 1
        skip[second] = start
        pair = _mix(last * s.contexts + skip, s.pairs)
        features = np.stack([last, s.contexts + skip, 2 * s.contexts + pair])
        return bounds, names, number, stream, at, features

    def _pass(self, table: int, rows: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log P of the targets (natural); when learning also adds what the model expects to every feature's row."""
        w = self.weights[table]
        z = w.take(rows[0], 0)
        for r in rows[1:]:
            z += w.take(r, 0)
        z += bias
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        total = e.sum(1)
        out = z[np.arange(len(target)), target] - np.log(total)
        if self.expected is not None:
            e /= total[:, None]
            for r in rows:
                own, sums = _by_row(r, e)
                self.expected[table][own] += sums
                at, n = np.unique(r * w.shape[1] + target, return_counts=True)
                self.met[table].reshape(-1)[at] += n
        return out

    def run(self, at: np.ndarray, features: np.ndarray) -> np.ndarray:
        """log P (natural) of each token but for its share of a tail class, in batches."""
        s = self.lexicon.settings
        out = np.zeros(len(at))
        for lo in range(0, len(at), s.step):
            place, rows = at[lo : lo + s.step], features[:, lo : lo + s.step]
            own = place < s.own
            group = np.where(own, place // s.members, s.classes + place - s.own)
            got = self._pass(0, rows, self.lexicon.outer_bias, group)
            if own.any():
                inside, k = rows[:, own], group[own]
                hashed = _mix(inside * s.classes + k, s.inner)
                got[own] += self._pass(1, hashed, self.lexicon.inner_bias[k], place[own] % s.members)
            out[lo : lo + s.step] = got
        return out


def updated(weights: np.ndarray, expected: np.ndarray, met: np.ndarray, shy: float) -> np.ndarray:
    """One step: the gradient (met less expected) by what is expected, in logarithms, a third for each of the three features.

    ``shy`` tokens more are taken to have met each outcome as the model expects, so what few tokens say moves little.
    """
    expected = expected.astype(np.float64)
    step = np.log1p((met - expected) / (expected + shy)) / 3
    return (weights + step).astype(np.float32)


_BLOCKS = T.StructType([T.StructField(n, t) for n, t in (("kind", T.IntegerType()), ("block", T.IntegerType()), ("salt", T.IntegerType()), ("tokens", T.LongType()), ("sums", T.BinaryType()))])


def _summed(frames: DataFrame) -> DataFrame:
    """One level of a tree of sums: blocks, and their tokens, of every FAN_IN salts become one."""
    import pandas as pd

    def add(group):
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in group["sums"])
        row = {"kind": group["kind"].iloc[0], "block": group["block"].iloc[0], "salt": group["salt"].iloc[0], "tokens": group["tokens"].sum(), "sums": total.astype(np.float32).tobytes()}
        return pd.DataFrame([row])

    return frames.withColumn("salt", F.expr(f"salt div {FAN_IN}").cast("int")).groupBy("kind", "block", "salt").applyInPandas(add, _BLOCKS)


def train(docs: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """docs: train, text, group. A round of updates over each group of the training documents.

    A round's tasks are about the square root of the table's partitions, so that their sums, which have the size of the
    weights, stay in proportion to the input.
    """
    s = lexicon.settings
    weights = tuple(np.zeros(shape, np.float32) for shape in s.shapes())
    tasks = max(1, math.isqrt(docs.rdd.getNumPartitions()))

    for k in range(s.rounds):

        def count(batches: Iterator[pa.RecordBatch], given=weights) -> Iterator[pa.RecordBatch]:
            model, seen = Model(lexicon, given), 0
            model.learn()
            for batch in batches:
                _, _, _, _, at, features = model.batch(batch.column(0))
                model.run(at, features)
                seen += len(at)
            if not seen:
                return
            salt = TaskContext.get().partitionId()
            for kind, table in enumerate([*model.expected, *model.met]):
                there = [j for j in range(0, len(table), s.block) if table[j : j + s.block].any()]
                n = len(there)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * n, pa.int32()), pa.array([j // s.block for j in there], pa.int32()), pa.array([salt] * n, pa.int32()), pa.array([seen] * n, pa.int64()), pa.array([table[j : j + s.block].tobytes() for j in there], pa.binary())],
                    names=_BLOCKS.names,
                )

        rows = docs.where((F.col("train")) & (F.col("group") == k)).select("text")
        sums = staged(rows.coalesce(max(tasks, 6) if tasks > 1 else 1).mapInArrow(count, _BLOCKS), "sums")
        left = (sums.agg(F.max("salt")).first()[0] or 0) + 1
        while left > 1:
            sums, left = _summed(sums), -(-left // FAN_IN)
        found = [np.zeros_like(w) for w in weights] + [np.zeros_like(w) for w in weights]
        for r in sums.collect():
            part = found[r["kind"]][r["block"] * s.block : (r["block"] + 1) * s.block]
            part += np.frombuffer(r["sums"], np.float32).reshape(part.shape)
        weights = tuple(updated(w, e, m, s.shy) for w, e, m in zip(weights, found[:2], found[2:]))
    return weights


def lexicon_of(words: DataFrame, settings: Settings) -> Lexicon:
    """words: the counts of all words. The driver gets at most ``frequent`` rows, and a few for counts and tails."""
    total, distinct = words.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.count(F.when(F.col("trained") > 0, 1))).first()
    settings = settings.sized(total)
    # whole steps of counts from the top, told apart by eighths of a doubling, and of the step that is too large a share by hash
    known = words.where("trained > 0")
    step = F.floor(F.log2("trained") * 8).cast("int")
    steps = sorted(((r["s"], r["n"]) for r in known.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    chosen, room = F.lit(True), settings.frequent
    for k, n in steps:
        if n > room:
            chosen = (step > k) | ((step == k) & (F.pmod(F.xxhash64("word"), F.lit(n)) < room))
            break
        room -= n
    chosen = (F.col("word") == END) | ((F.col("trained") > 0) & chosen)
    chosen = words.where(F.coalesce(chosen, F.lit(False))).select("word", "trained").toArrow()
    rows = sorted(zip(chosen["word"].to_pylist(), chosen["trained"].to_pylist()))
    tails = {r["t"]: [r["c"], r["v"]] for r in words.where("trained > 0").groupBy(tail_column(F.col("word"), settings.tails).alias("t")).agg(F.sum("trained").alias("c"), F.count("*").alias("v")).collect()}
    for w, c in Lexicon.best(rows, settings):
        own = tails[tail_of(w, settings.tails)]
        own[0] -= c
        own[1] -= 1
    return Lexicon(settings, rows, total, distinct, {t: tuple(x) for t, x in tails.items()})


_SCORED = T.StructType(
    [T.StructField(n, t) for n, t in (("n", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType()))]
    + [T.StructField("rare", T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("times", T.LongType())])))]
)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text).

    Documents whose crc32(key as text) mod 5 is not 1 are the training documents. Null texts are empty: one
    token, the end. A null key counts as an empty text there and passes through; repeated rows count and are
    scored each; with no training documents nothing is known and both scores are those of the smoothing;
    an empty table gives an empty result. Only key and text are read.
    """
    rows = docs.select(F.col(key).alias("_key"), (~held_out(F.col(key))).alias("train"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = count_words(rows, settings)
    lexicon = lexicon_of(words, settings)
    settings = lexicon.settings
    weights = train(rows.withColumn("group", F.pmod(F.xxhash64("_key", "text"), F.lit(settings.rounds))), lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(lexicon, weights)
        s = settings
        for batch in batches:
            bounds, names, number, stream, at, features = model.batch(batch.column(1))
            logs = model.run(at, features) / np.log(10)
            frequent = number[stream] >= 0
            count = np.where(frequent, lexicon.count[number[stream]], 0.0)
            base = np.where(frequent, lexicon.log_base(count), 0.0)
            tail = (at >= s.own) & frequent
            logs[tail] += lexicon.in_tail(at[tail] - s.own, count[tail])
            add = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  no text is without its end
            rare = np.flatnonzero(~frequent)
            doc = np.searchsorted(bounds, rare, "right") - 1
            pairs, times = np.unique(doc * len(names) + stream[rare], return_counts=True)
            doc, word = pairs // len(names), pairs % len(names)
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(doc, np.arange(len(bounds))), pa.int32()),
                pa.StructArray.from_arrays([names.take(pa.array(word)).cast(pa.string()), pa.array(times, pa.int64())], names=["word", "times"]),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(bounds)), pa.array(add((frequent & (count > 0)).astype(np.int64))), pa.array(add(base)), pa.array(add(logs)), lists],
                names=["row", "n", "known", "base", "score", "rare"],
            )

    marked = rows.select(F.struct("_key", "train").alias("row"), "text")
    out = T.StructType([T.StructField("row", marked.schema["row"].dataType), *_SCORED.fields])
    scored = staged(marked.mapInArrow(run, out).withColumn("id", F.monotonically_increasing_id()), "scored")
    rare = scored.select("id", F.explode("rare").alias("r")).select("id", "r.word", "r.times")
    counts = words.where("trained > 0").select("word", "trained")
    tails = F.array(*[F.lit(float(c + 0.5 * (v + 1))) for c, v in zip(lexicon.tail_total, lexicon.tail_distinct)])
    found = rare.join(counts.hint("shuffle_hash"), "word", "left").withColumn("c", F.coalesce("trained", F.lit(0)) + 0.5)
    whole = float(lexicon.total + 0.5 * (lexicon.distinct + 1))
    sums = found.groupBy("id").agg(
        F.sum(F.when(F.col("trained").isNotNull(), F.col("times")).otherwise(0)).alias("_known"),
        F.sum(F.col("times") * F.log10(F.col("c") / whole)).alias("_base"),
        F.sum(F.col("times") * F.log10(F.col("c") / F.get(tails, tail_column(F.col("word"), settings.tails)))).alias("_score"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.drop("rare").join(sums, "id", "left").select(
        F.col("row._key").alias(key),
        (~F.col("row.train")).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + zero("_known")).cast("long").alias("n_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("_base")).alias("base_score"),
        (F.col("score") + zero("_score")).alias("score"),
    )

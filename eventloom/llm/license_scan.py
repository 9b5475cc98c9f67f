"""Operator 1: license texts and notices inside documents.

Templates are winnowed: of every few word triples in a row the one with the least hash is a fingerprint,
and an inverted index leads from fingerprints to templates and places.  A text is winnowed the same way, so
any run of five words that it shares with a template hits the index.  Hits near one diagonal are a
candidate; a banded local alignment of the template's words with the text around it counts the words that
match and finds the span, and again on either side of it while hits are left there.  Parts of one template
that don't cover enough but follow each other in text and template, however far apart, are added up.
Reported is what covers enough of a template and whose parts lie in no better match.

Whole texts are scanned one by one, so no group meets in a task; the index has a fixed size.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .license_texts import TEMPLATES

GRAM = 3
#: Fingerprints are the least of so many neighbouring triples: a shared run of GRAM + WINDOW - 1 words is always hit.
WINDOW = 3
BAND = 12
COVERAGE = 0.6
#: Templates together hold at most this many words, which bounds what is sent to tasks.
MOST_WORDS = 1_000_000

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_PLAIN = bytes(x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))
_MATCH, _OTHER, _GAP = 2, -1, -1

HIT = T.StructType(
    [
        T.StructField("license", T.StringType()),
        T.StructField("coverage", T.DoubleType()),
        T.StructField("matched_words", T.LongType()),
        T.StructField("template_words", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
    ]
)


def _words(text: bytes) -> list[bytes]:
    return text.lower().translate(_PLAIN).split()


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash (the last of equals) of every ``window`` neighbours; all there is if fewer."""
    n = len(hashes)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))]) if n else np.zeros(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(rows)) + window - 1 - rows.argmin(1))


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int, int, int, int]:
    """Banded local alignment: score, matched words, first and last matched word of the text and of the template.

    Cell (i, j) matches template word i with text word i + diagonal - band + j.
    """
    m, width = len(template), 2 * band + 1
    score = np.zeros((m + 1, width + 1), np.int32)
    steps = np.arange(width)
    at = np.arange(m)[:, None] + diagonal - band + steps
    inside = (at >= 0) & (at < len(text))
    equal = np.where(inside, text[np.clip(at, 0, len(text) - 1)], -2) == template[:, None]
    for i in range(1, m + 1):
        best = np.maximum(score[i - 1, :width] + np.where(equal[i - 1], _MATCH, _OTHER), score[i - 1, 1:] + _GAP)
        best = np.where(inside[i - 1], np.maximum(best, 0), 0)
        # gaps along the row: the best of what stands left of a cell, less its distance
        row = np.maximum.accumulate(best - _GAP * steps) + _GAP * steps
        score[i, :width] = np.where(inside[i - 1], np.maximum(best, row), 0)
    i, j = (int(x) for x in np.unravel_index(int(score.argmax()), score.shape))
    top, matched = int(score[i, j]), 0
    first = last = first_template = last_template = -1
    while i > 0 and score[i, j] > 0:
        here = score[i, j]
        if here == score[i - 1, j] + (_MATCH if equal[i - 1, j] else _OTHER):
            if equal[i - 1, j]:
                matched += 1
                first, first_template = int(at[i - 1, j]), i - 1
                if last < 0:
                    last, last_template = first, first_template
            i -= 1
        elif here == score[i - 1, j + 1] + _GAP:
            i, j = i - 1, j + 1
        elif j > 0 and here == score[i, j - 1] + _GAP:
            j -= 1
        else:
            break
    return top, matched, first, last, first_template, last_template


def _ranked(k: int, chain: list[tuple]) -> tuple:
    """More matching words, then the shorter span, then the earlier."""
    first, last = chain[0][0], chain[-1][1]
    return sum(x[2] for x in chain), -(last - first), -first, k, chain


def _chains(parts: list[tuple], least: float) -> list[list[tuple]]:
    """Disjoint chains of parts (as of Index._parts) that follow each other in text and template and match ``least`` words together.

    Template words that two neighbours both cover count once.
    """
    parts, out = sorted(set(parts)), []
    while sum(x[2] for x in parts) >= least:
        first, last, matched, low, high = np.array(parts).T
        best, before = matched.copy(), np.full(len(parts), -1)
        for j in range(1, len(parts)):
            gain = best[:j] - np.maximum(0, high[:j] + 1 - low[j])
            gain = np.where((last[:j] < first[j]) & (low[:j] < low[j]) & (high[:j] < high[j]), gain, 0)
            i = int(gain.argmax())
            if gain[i] > 0:
                best[j] += gain[i]
                before[j] = i
        j = int(best.argmax())
        if best[j] < least:
            break
        chain = []
        while j >= 0:
            i = int(before[j])
            chain.append((*parts[j][:2], int(best[j] - (best[i] if i >= 0 else 0)), *parts[j][3:]))
            j = i
        out.append(chain[::-1])
        parts = [x for x in parts if all(x[1] < c[0] or c[1] < x[0] for c in chain)]
    return out


class Index:
    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names = [n for n, _ in templates]
        texts = [_words(t.encode()) for _, t in templates]
        if sum(map(len, texts)) > MOST_WORDS:
            raise ValueError(f"templates of more than {MOST_WORDS} words")
        self.words: dict[bytes, int] = {}
        for t in texts:
            for w in t:
                self.words.setdefault(w, len(self.words))
        self.hash = np.array([xxhash.xxh64_intdigest(w) for w in self.words] or [0], np.uint64)
        self.texts = [np.array([self.words[w] for w in t], np.int64) for t in texts]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, ids in enumerate(self.texts):
            hashes = self._grams(ids)
            for p in winnow(hashes):
                self.places[int(hashes[p])].append((k, int(p)))

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        n = max(0, len(ids) - GRAM + 1)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(GRAM):
                out = out * np.uint64(0x9E3779B97F4A7C15) + self.hash[ids[k : k + n]]
            return out ^ (out >> np.uint64(29))

    def _parts(self, k: int, ids: np.ndarray, seeds: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
        """One candidate's alignments: first and last word of the text, matched words, first and last of the template.

        What stands on either side of an alignment is aligned again as long as a shared triple is left there.
        """
        template, out = self.texts[k], []
        middle = (seeds[0][0] + seeds[-1][0]) // 2
        waiting = [(max(0, middle - BAND), min(len(ids), middle + len(template) + BAND + 1))]
        while waiting:
            lo, hi = waiting.pop()
            if not any(lo <= p and p + GRAM <= hi for _, p in seeds):
                continue
            _, matched, first, last, first_template, last_template = align(template, ids[lo:hi], middle - lo)
            if matched:
                out.append((lo + first, lo + last, matched, first_template, last_template))
                waiting += [(lo, lo + first), (lo + last + 1, hi)]
        return out

    def scan(self, text: bytes | None, coverage: float = COVERAGE) -> list[tuple]:
        """Rows of HIT, by place in the text."""
        tokens = _words(text) if text else []
        ids = np.array(list(map(self.words.get, tokens, (-1,) * len(tokens))), np.int64)
        # only runs of template words can hold a template's triple
        known = np.r_[False, ids >= 0, False]
        edge = np.flatnonzero(known[1:] != known[:-1])
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for lo, hi in zip(edge[::2], edge[1::2]):
            if hi - lo < GRAM:
                continue
            hashes = self._grams(ids[lo:hi])
            for p in winnow(hashes):
                for k, q in self.places.get(int(hashes[p]), ()):
                    seeds[k].append((int(lo + p) - q, int(lo + p)))
        found = []
        for k, own in seeds.items():
            size = len(self.texts[k])
            own = sorted(set(own))
            parts, start = [], 0
            for e in range(1, len(own) + 1):
                if e == len(own) or own[e][0] - own[start][0] > BAND:
                    parts += self._parts(k, ids, own[start:e])
                    start = e
            hits = [[x] for x in parts if x[2] >= coverage * size]
            found += [_ranked(k, chain) for chain in [*hits, *_chains([x for x in parts if x[2] < coverage * size], coverage * size)]]
        kept: list[tuple[int, int]] = []
        rows: list[tuple[int, int, int, int]] = []
        for matched, _, _, k, chain in sorted(found, reverse=True):
            # what is kept is disjoint and in order, so only the two neighbours of a part can overlap it
            at = [bisect(kept, first, key=lambda x: x[0]) for first, *_ in chain]
            if all((i == 0 or kept[i - 1][1] < x[0]) and (i == len(kept) or x[1] < kept[i][0]) for i, x in zip(at, chain)):
                for i, x in reversed(list(zip(at, chain))):
                    kept.insert(i, x[:2])
                rows.append((chain[0][0], chain[-1][1], k, matched))
        rows.sort()
        if not rows:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        #: Characters before each byte.
        chars = np.r_[0, np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)]
        return [
            (self.names[k], matched / len(self.texts[k]), matched, len(self.texts[k]), first, last, int(chars[spans[first][0]]), int(chars[spans[last][1]]))
            for first, last, k, matched in rows
        ]


@lru_cache(maxsize=2)
def _index(templates: tuple) -> Index:
    return Index(templates)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per license text found in a document: key and the columns of HIT.

    coverage is the share of the template's words that match; first_word and last_word count runs of letters and
    digits, start and end characters (end exclusive).  A match in several parts spans from its first to its last,
    and other matches may stand between its parts.  Parts don't overlap: the match with more matching words
    wins, then the shorter span, then the earlier.  Null and empty texts have no match; repeated rows give
    rows each; null keys pass through; an empty table gives an empty result. Only key and text are read.
    """
    given = tuple(sorted((TEMPLATES if templates is None else templates).items()))
    _index(given)

    @F.pandas_udf(T.ArrayType(HIT))
    def hits(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _index(given)
        for batch in texts:
            yield pd.Series([[dict(zip(HIT.names, h, strict=True)) for h in index.scan(x, coverage)] for x in batch])

    rows = docs.select(F.col(key), F.explode(hits(F.col(text).cast("binary"))).alias("hit"))
    return rows.select(key, "hit.*")

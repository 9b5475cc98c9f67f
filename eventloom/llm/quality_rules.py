"""Operator 4: quality rules as weak supervision.

Nine rules look at counts of a text and vote good (+), bad (-) or abstain (0).  How far each rule can
be trusted is not set by hand: votes of all documents are counted by pattern (at most 3^9 of them, so
the counts fit anywhere), expectation-maximisation fits for either class how often each rule that votes votes
bad, and a document is kept by the posterior probability that it is good.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import staged
from .text import duplicate_lines, repeated_words, words

_SPACE = bytes([9, 10, 11, 12, 13, 32])
_SYMBOLS = b"#*$%&|<>"
_CAPITALS, _SMALL = bytes(range(65, 91)), bytes(range(97, 123))
_MARKS = re.compile(rb"[!-/:-@\[-`{-~]{2}(?=\s|\Z)|(?<!\S)[!-/:-@\[-`{-~](?=\s|\Z)").findall
_ENDS = re.compile(rb"[.!?][\")]?(?=\s|\Z)").findall

#: The rules in the order of their votes: name, what it looks at.
RULES = (
    ("enough_words", "votes good from 30 words, else abstains"),
    ("symbols", "symbols per word: bad over 0.1, good under 0.02"),
    ("repeats", "share of words in repeated windows: bad over 0.1, good under 0.02"),
    ("duplicate_lines", "share of lines equal to an earlier one: bad over 0.3, good at none of at least 3"),
    ("upper_case", "share of capitals in ASCII letters: bad over 0.4, good under 0.15"),
    ("word_length", "mean code points of a word: bad under 2 or over 14, good from 3 to 10"),
    ("marks", "share of words that end in two ASCII marks or are one: bad over 0.15, good under 0.02"),
    ("sentences", "words per sentence end: bad over 200 or none in 60 words, good from 3 to 60"),
    ("one_word", "share of the commonest word, from 30 words: bad over 0.3, good under 0.2"),
)
MEASURES = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("votes", T.StringType())]
)


def _vote(bad: bool, good: bool) -> str:
    return "-" if bad else "+" if good else "0"


def measure(text: bytes | None) -> tuple:
    """One document's row of MEASURES. Null counts as empty; every count is over the whole text."""
    text = text or b""
    tokens = words(text)
    n = len(tokens)
    word_chars = len(text.translate(None, _SPACE).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    dup_lines = duplicate_lines(text)
    repeats = repeated_words(tokens)
    failed = n < 10 or 100 * repeats > 20 * n
    if not n:
        return 0, 0, symbols, 0, 0, True, "0" * len(RULES)
    lines = text.count(b"\n") + 1
    upper = len(text) - len(text.translate(None, _CAPITALS))
    cased = upper + len(text) - len(text.translate(None, _SMALL))
    marks = len(_MARKS(text))
    ends = len(_ENDS(text))
    commonest = 0
    if n >= 30:
        commonest = max(Counter(tokens).values())
    votes = (
        _vote(False, n >= 30),
        _vote(symbols > 0.1 * n, symbols < 0.02 * n),
        _vote(repeats > 0.1 * n, repeats < 0.02 * n),
        _vote(dup_lines > 0.3 * lines, dup_lines == 0 and lines >= 3),
        _vote(upper > 0.4 * cased, upper < 0.15 * cased),
        _vote(not 2 * n <= word_chars <= 14 * n, 3 * n <= word_chars <= 10 * n),
        _vote(marks > 0.15 * n, marks < 0.02 * n),
        _vote(n > 200 * ends if ends else n >= 60, 3 * ends <= n <= 60 * ends),
        _vote(commonest > 0.3 * n, n >= 30 and commonest < 0.2 * n),
    )
    return n, word_chars, symbols, dup_lines, repeats, failed, "".join(votes)


@F.pandas_udf(MEASURES)
def _measured(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([measure(x) for x in batch], columns=MEASURES.names)


def measures(text: Column) -> Column:
    return _measured(text.cast("binary"))


@dataclass(frozen=True)
class Fit:
    """prior: probability of good. bad[class, rule]: chance that the rule votes bad if it votes; class 0 bad, 1 good."""

    prior: float
    bad: np.ndarray
    patterns: dict[str, float]

    def posterior(self, votes: str) -> float:
        return float(_posterior(_coded([votes]), self.prior, self.bad)[0][0])


def _coded(patterns: list[str]) -> np.ndarray:
    return np.array([["-0+".index(v) - 1 for v in p] for p in patterns], int).reshape(len(patterns), len(RULES))


def _posterior(votes: np.ndarray, prior: float, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good for each pattern, and the pattern's log likelihood. A rule that abstains says nothing."""
    each = [np.log(p) + (votes < 0) @ np.log(bad[c]) + (votes > 0) @ np.log1p(-bad[c]) for c, p in ((0, 1 - prior), (1, prior))]
    whole = np.logaddexp(*each)
    return np.exp(each[1] - whole), whole


#: Fixed values of the fit: starts as (chance of a bad vote in bad documents, in good ones, share of good documents).
STARTS = ((0.30, 0.02, 0.85), (0.50, 0.05, 0.60), (0.15, 0.01, 0.40), (0.60, 0.10, 0.95))


def fit(counts: dict[str, int], rounds: int = 200, weight: float = 20.0) -> Fit:
    """Expectation-maximisation over pattern counts, from several starts; the likeliest end counts.

    The first start, as if seen in ``weight`` documents of either class, is the prior, which any number of documents outweighs:
    it gives sane chances where there are few documents or none.  Nothing else holds the values.  The good
    class is the one in which rules vote bad less often.
    """
    names = sorted(counts)
    votes, seen = _coded(names), np.array([counts[p] for p in names], float)
    anchor = np.repeat(np.array(STARTS[0][:2])[:, None], len(RULES), axis=1)
    ends = []
    for at_bad, at_good, prior in STARTS if names else STARTS[:1]:
        bad = np.repeat(np.array([at_bad, at_good])[:, None], len(RULES), axis=1)
        for _ in range(rounds if names else 0):
            good, _ = _posterior(votes, prior, bad)
            mass = np.stack([1 - good, good]) * seen
            bad = (mass @ (votes < 0) + weight * anchor) / (mass @ (votes != 0) + weight)
            prior = float((mass[1].sum() + weight * STARTS[0][2]) / (seen.sum() + weight))
        if bad[0].sum() < bad[1].sum():
            bad, prior = bad[::-1], 1 - prior
        likely = (seen * _posterior(votes, prior, bad)[1]).sum() + weight * (anchor * np.log(bad) + (1 - anchor) * np.log1p(-bad)).sum()
        ends.append((float(likely), prior, bad))
    _, prior, bad = max(ends, key=lambda x: x[0])
    found = dict(zip(names, _posterior(votes, prior, bad)[0].tolist(), strict=True)) if names else {}
    return Fit(prior, bad, found)


def pattern_counts(measured: DataFrame) -> dict[str, int]:
    """Documents that pass the base rules by vote pattern: at most 2 * 3^len(RULES) rows go to the driver, whatever the input.

    Those that fail are counted too and dropped here: a filter would make Spark measure the texts twice.
    """
    counted = measured.groupBy("votes", "base_failed").agg(F.count("*").alias("n")).collect()
    return {r["votes"]: r["n"] for r in counted if not r["base_failed"]}


def verdicts(measured: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds ``posterior`` and ``kept`` to rows with the columns of MEASURES, which must be cheap to read twice.

    Documents that fail the base rules are decided: they are not kept, have no posterior and don't count in
    the fit.
    """
    found = fit(pattern_counts(measured)).patterns
    table = measured.sparkSession.createDataFrame(sorted(found.items()), "votes string, posterior double")
    out = measured.join(F.broadcast(table), "votes", "left")
    return out.withColumn("posterior", F.when(~F.col("base_failed"), F.col("posterior"))).withColumn("kept", F.coalesce(F.col("posterior") >= threshold, F.lit(False)))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: key, the counts, base_failed, votes, posterior, kept.

    Null and empty texts have no words, fail the base rules and abstain everywhere; equal texts get equal
    verdicts; repeated rows stay; a null key passes through; an empty table gives an empty result. No
    column but key and text is read.
    """
    rows = staged(docs.select(F.col(key), measures(F.col(text)).alias("m")).select(key, "m.*"), "measures")
    return verdicts(rows, threshold)


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text is kept.

    Texts are measured once: the rows are written with their votes, and read to fit and to filter.
    """
    own = "_quality"
    while own in docs.columns:
        own += "_"
    measured = staged(docs.withColumn(own, measures(F.col(f"`{text}`"))), "measured")
    found = fit(pattern_counts(measured.select(f"{own}.*"))).patterns
    kept = [v for v, p in found.items() if p >= threshold]
    return measured.where(~F.col(f"{own}.base_failed") & F.col(f"{own}.votes").isin(kept)).drop(own)

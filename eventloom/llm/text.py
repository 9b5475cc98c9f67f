"""Words and lines of texts, as bytes of UTF-8.

A word is a run of bytes other than space and 09 to 0D; ``bytes.split()`` cuts at exactly these, and
``bytes.lower()`` changes A-Z alone.
"""

from __future__ import annotations

import numpy as np


def words(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def numbered(tokens: list[bytes]) -> tuple[np.ndarray, int]:
    """Numbers that are equal where the words are, and how many differ."""
    seen: dict[bytes, int] = {}
    put = seen.setdefault
    return np.array([put(w, len(seen)) for w in tokens], np.int64), len(seen)


def repeated_words(tokens: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that the text has twice or more, the first ones included. Exact: no hashing."""
    n = len(tokens) - width + 1
    if n < 2:
        return 0
    code, base = numbered(tokens)
    ids, span = code, base
    window = ids[:n].copy()
    for k in range(1, width):
        if span * base >= 1 << 62:
            window = np.unique(window, return_inverse=True)[1].astype(np.int64)
            span = int(window.max()) + 1
        window = window * base + ids[k : k + n]
        span *= base
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, np.int32)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    ends = np.zeros(len(tokens) + 1, np.int32)
    ends[:n] += twice
    ends[width : width + n] -= twice
    return int((np.cumsum(ends[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\v\f")]
    return len(lines) - len(set(lines))

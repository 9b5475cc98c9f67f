"""Minimal perfect hashing of 64-bit key hashes, with fingerprints, in numpy arrays.

Level by level every key that is not placed yet picks a bit; bits picked once are set and their keys
placed, the others go on to the next level.  A key's slot is the number of set bits before its own.  A
stored 32-bit fingerprint of the slot's key tells foreign keys apart.
"""

from __future__ import annotations

import io
import json

import numpy as np

_LEVELS = 64


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalising mix of keys and a seed."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64(seed + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1000) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Slots 0..n-1 for n distinct 64-bit keys; about 4 bits a key, and 32 for its fingerprint."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, before: np.ndarray, prints: np.ndarray):
        self.sizes, self.bits, self.before, self.prints = sizes, bits, before, prints
        self._starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        keys = np.ascontiguousarray(keys, np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two keys have the same 64-bit hash")
        sizes, words, rest = [], [], keys
        for level in range(_LEVELS):
            if not len(rest):
                break
            size = -(-max(64, int(gamma * len(rest))) // 64) * 64
            at = (mixed(rest, level) % np.uint64(size)).astype(np.int64)
            once = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(once, bitorder="little").view("<u8"))
            sizes.append(size)
            rest = rest[~once[at]]
        if len(rest):
            raise ValueError("keys could not be placed")
        bits = np.concatenate(words) if words else np.zeros(0, "<u8")
        before = np.r_[0, np.cumsum(np.bitwise_count(bits))].astype("<u4")
        out = cls(np.array(sizes, "<u8"), bits, before, np.zeros(len(keys), "<u4"))
        out.prints[out._slots(keys)] = _fingerprints(keys)
        return out

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slots = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(rest):
                break
            at = (mixed(keys[rest], level) % np.uint64(size)).astype(np.int64) + self._starts[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            slots[rest[hit]] = self.before[word[hit]] + np.bitwise_count(below[hit])
            rest = rest[~hit]
        return slots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where the key isn't one of those the hash was built on (but for one in 2^32 of foreign keys)."""
        keys = np.ascontiguousarray(keys, np.uint64)
        slots = self._slots(keys)
        if len(self.prints):
            slots[(slots >= 0) & (self.prints[slots] != _fingerprints(keys))] = -1
        return slots

    def arrays(self) -> dict[str, np.ndarray]:
        return {"sizes": self.sizes, "bits": self.bits, "before": self.before, "prints": self.prints}


def packed(arrays: dict[str, np.ndarray], **head) -> bytes:
    """One line of JSON (names, kinds and lengths of the arrays, and ``head``), then the raw arrays."""
    out = io.BytesIO()
    kinds = [[name, a.dtype.str, len(a)] for name, a in arrays.items()]
    out.write(json.dumps({"arrays": kinds, **head}).encode() + b"\n")
    for a in arrays.values():
        out.write(a.tobytes())
    return out.getvalue()


def unpacked(raw: bytes) -> tuple[dict[str, np.ndarray], dict]:
    at = raw.index(b"\n") + 1
    head = json.loads(raw[:at])
    arrays = {}
    for name, kind, n in head.pop("arrays"):
        arrays[name] = np.frombuffer(raw, kind, n, at)
        at += arrays[name].nbytes
    return arrays, head

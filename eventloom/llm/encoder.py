"""Token ids of whole texts with a public tokenizer file, quickly.

Both known kinds of file cut a text at white space before anything else, and what lies between two cuts
has the same ids wherever it stands.  So a batch of texts is cut into units by Arrow, each distinct unit is
encoded once, and a text's ids are its units' ids in a row; units met before are kept in a bounded table.
Texts in which the cut rules could matter (characters outside a plain range, unusual runs of white space)
that hold one of the file's added tokens (such as ``<|endoftext|>``, which the tokenizer finds inside a text), and other
kinds of file go to the tokenizer whole.  Either way the ids are those of the library's own
``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A text with other characters goes to the tokenizer whole; of the byte kind, one with other white space than single spaces and one or two line ends does too.
_ODD = re.compile("[^\t\n\r\x20-\x7e¡-ɏ‐-‧€]")
_BLANKS = ("  ", " \n", "\n ", "\n\n\n", "\t", "\r")
#: Between units when many are encoded as one text: never part of a unit or of a longer token.
_MARK = "\x01"
#: Units kept in a worker's table, and characters of text cut at a time.
KEPT = 200_000
BATCH_CHARS = 4_000_000
JOINED = 200


class Encoder:
    def __init__(self, path: str, kept: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._kept: dict[str, bytes] = {}
        self._limit = kept
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        self._kind = self._kind_of(read)
        #: Added tokens, found in the text as it is; those that are found after normalising are looked for in any case.
        added = read.get("added_tokens") or []
        self._added = [t["content"] for t in added if t["content"]]
        self._any_case = [t["content"].lower() for t in added if t["content"] and t.get("normalized")]
        mark = self._ids([_MARK])[0]
        self._mark = int(mark[0]) if len(mark) else -1
        if len(mark) != 1:
            self._kind = None
        self.size = self._tokenizer.get_vocab_size()

    @staticmethod
    def _kind_of(file: dict) -> str | None:
        cut = file.get("pre_tokenizer") or {}
        if not file.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space"):
            return "byte"
        steps = cut.get("pretokenizers") or [{}]
        normal = [x.get("type") for x in (file.get("normalizer") or {}).get("normalizers", [])]
        if normal == ["NFC", "Replace", "Lowercase"] and steps[0].get("behavior") == "Removed" and steps[0].get("invert"):
            return "word"
        return None

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, texts: list[str]) -> pa.ListArray:
        """Byte kind: a unit starts at a space, which is left out, or at a line end, which stays; the text's start counts as a line end."""
        if self._kind == "word":
            return pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        return pc.split_pattern(pc.replace_substring(pa.array(["\n" + x for x in texts], pa.large_string()), "\n", " \n"), " ")

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of units, encoded as one text with marks between."""
        found: dict[str, bytes] = {"": b""}
        new = [u for u in new if u]
        for at in range(0, len(new), JOINED):
            part = new[at : at + JOINED]
            whole = part if self._kind == "word" else [u if u[:1] == "\n" else " " + u for u in part]
            ids = self._ids([f" {_MARK} ".join(whole) if self._kind == "word" else _MARK.join(whole)])[0]
            marks = np.flatnonzero(ids == self._mark)
            if len(marks) != len(part) - 1:
                found |= {w: x.tobytes() for w, x in zip(part, self._ids(whole), strict=True)}
                continue
            raw = ids.tobytes()
            ends = [*(4 * marks).tolist(), len(raw)]
            starts = [0, *(4 * marks + 4).tolist()]
            found.update(zip(part, [raw[a:b] for a, b in zip(starts, ends)], strict=True))
        return found

    def _by_units(self, texts: list[str]) -> list[bytes]:
        units = self._units(texts)
        bounds = units.offsets.to_numpy().astype(np.int64)
        coded = units.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds -= bounds[0]
        # one joined string, cut by Python, is much quicker to get than each word
        words = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        names = pc.binary_join(words, pa.scalar(_MARK, coded.dictionary.type))[0].as_py().split(_MARK)
        kept = self._kept
        ids = list(map(kept.get, names))
        new = self._learn([n for n, x in zip(names, ids) if x is None])
        if len(kept) < self._limit:
            kept.update(new)
        ids = [new[n] if x is None else x for n, x in zip(names, ids)]
        joined = pa.array(ids, pa.large_binary()).take(coded.indices)
        raw = memoryview(joined.buffers()[2])
        cuts = np.frombuffer(joined.buffers()[1], np.int64)[bounds]
        # the byte kind's texts begin with an empty unit and with a line end of our own, which is one id
        own = 4 if self._kind == "byte" else 0
        return [bytes(raw[a + own : b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _plain(self, text: str) -> bool:
        if self._kind is None or _ODD.search(text) or any(t in text for t in self._added):
            return False
        if self._any_case and any(t in text.lower() for t in self._any_case):
            return False
        return self._kind == "word" or not (text[0] == " " or text[-1] == " " or text.endswith("\n\n") or any(b in text for b in _BLANKS))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; an empty text has none."""
        out: list[bytes] = [b""] * len(texts)
        plain = [k for k, x in enumerate(texts) if x and self._plain(x)]
        whole = sorted({k for k, x in enumerate(texts) if x}.difference(plain))
        for k, ids in zip(whole, self._ids([texts[k] for k in whole]), strict=True):
            out[k] = ids.tobytes()
        at = 0
        while at < len(plain):
            size, end = 0, at
            while end < len(plain) and size < BATCH_CHARS:
                size += len(texts[plain[end]])
                end += 1
            for k, ids in zip(plain[at:end], self._by_units([texts[k] for k in plain[at:end]]), strict=True):
                out[k] = ids
            at = end
        # workers live on between tasks, and Arrow would keep what a batch needed
        pa.default_memory_pool().release_unused()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file in a Python worker."""
    return Encoder(path)


def resolve(tokenizer: str) -> str:
    """Path of a tokenizer file on this machine: as given if it exists, else by the name of a public one."""
    if os.path.exists(tokenizer):
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)

"""Token counts with a whole-token shortcut (SentencePiece BPE models).

No piece of the vocabulary holds a space after another character, and a line
break is in no piece of more than one character (both are proven when the model
is loaded).  So no merge crosses those places, and a text falls into units that
encode on their own.  Units that encode alone as one token are proven offline,
by encoding every piece; a text's units are looked up there and only the rest,
each distinct one once, goes through the library's merges.

Nulls: null text counts as empty (0 bytes, 0 tokens); null doc_id stays null.
Texts with a NUL or U+2581, and all texts if the proofs fail for a model, are
encoded whole by the library.  Repeated rows each get a row; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbatch as tb

SLICE = 4 << 20
#: Distinct units whose counts a worker remembers; it starts anew when full, which changes no result.
REMEMBERED = 300_000
LIMIT = 4096
MARK = "▁"
_counters: dict[str, "Counter"] = {}


class Counter:
    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        # a text is its own normal form but for spaces: every character (NUL and MARK, which go their own way, aside), spaces in a row and at the ends, and marks behind letters
        probes = [" a  b\n c\tÅＡ ", "e\u0301 \u1100\u1161\u11a8 ﬁ", *("".join(map(chr, (*range(a, min(a + 4096, 0xD800)), *range(max(a, 0xE000), a + 4096)))).replace("\0", "").replace(MARK, "") for a in range(0, 0x20000, 4096))]
        own = all(self.sp.normalize(x) == (MARK + x).replace(" ", MARK) for x in probes if x)
        self.splits = own and not any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in pieces)
        self.line = self.count("\n\n") - self.count("\n") if self.splits else 0
        self.line_base = self.count("\n") if self.splits else 0
        one = []
        if self.splits:
            spaced = [p for p in pieces if p.startswith(MARK) and not p.strip(MARK) == ""]
            for p, ids in zip(spaced, self.sp.encode([p[1:].replace(MARK, " ") for p in spaced], num_threads=1), strict=True):
                if len(ids) == 1:
                    one.append(tb.hash_of(p.replace(MARK, " ")))
        self.whole = np.sort(np.array(one, np.uint64))
        self.known: dict[int, int] = {}

    def count(self, text: str) -> int:
        return len(self.sp.encode(text))

    def merge(self, units: list[str]) -> list[int]:
        """Tokens of units by the library.  It puts a space before a text, so a unit without one, or of spaces alone, goes behind a line break."""
        plain = [u[0] == " " and u.strip(" ") != "" for u in units]
        texts = [u[1:] if p else "\n" + u for p, u in zip(plain, units, strict=True)]
        return [len(ids) - (0 if p else self.line_base) for p, ids in zip(plain, self.sp.encode(texts, num_threads=1), strict=True)]

    def counts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        n = len(off) - 1
        full = np.flatnonzero(np.diff(off) > 0)
        total = np.zeros(n, np.int64)
        if not len(full):
            return total
        # each text with the space that the model puts before it
        out = np.insert(data, off[full], 0x20)
        start = off[full] + np.arange(len(full))
        bounds = np.append(start, len(out))
        odd = np.flatnonzero((out == 0) | (out == 0xE2))
        plain = np.ones(len(full), bool)
        for k in np.unique(np.searchsorted(bounds, odd, "right") - 1).tolist():
            text = out[bounds[k] + 1 : bounds[k + 1]].tobytes().decode("utf-8", "replace")
            if not self.splits or "\0" in text or MARK in text:
                plain[k] = False
                total[full[k]] = self.count(text)
        if not self.splits:
            for k in np.flatnonzero(plain).tolist():
                total[full[k]] = self.count(out[bounds[k] + 1 : bounds[k + 1]].tobytes().decode("utf-8", "replace"))
            return total
        space, line = out == 0x20, out == 0x0A
        begins = np.zeros(len(out), bool)
        begins[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        begins[start] = True
        s = np.flatnonzero(begins)
        e = np.append(s[1:], len(out))
        doc = np.searchsorted(start, s, "right") - 1
        c = np.zeros(len(s), np.int64)
        is_line = line[s]
        c[is_line] = self.line
        h = tb.hashes(out, s, e)
        known = tb.lookup(self.whole, h) >= 0
        c[known & ~is_line] = 1
        rest = np.flatnonzero(~known & ~is_line & plain[doc])
        if len(rest):
            u, at, inverse = np.unique(h[rest], return_index=True, return_inverse=True)
            if len(self.known) > REMEMBERED:
                self.known.clear()
            got = [self.known.get(x) for x in u.tolist()]
            new = [k for k, x in enumerate(got) if x is None]
            raw = out.tobytes()
            texts = [raw[s[rest[at[k]]] : e[rest[at[k]]]].decode("utf-8", "replace") for k in new]
            for k, x in zip(new, self.merge(texts), strict=True):
                got[k] = x
            self.known.update(zip(u[new].tolist(), (got[k] for k in new), strict=True))
            c[rest] = np.array(got, np.int64)[inverse]
        sums = np.bincount(doc, weights=c, minlength=len(full)).astype(np.int64)
        total[full[plain]] = sums[plain]
        return total


def counter(model_path: str) -> Counter:
    if model_path not in _counters:
        _counters[model_path] = Counter(model_path)
    return _counters[model_path]


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for b in batches:
            for i, j, data, off in tb.slices(b.column(1), SLICE):
                n = c.counts(data, off)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)

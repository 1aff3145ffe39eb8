"""Order-preserving packing by dynamic programming.

The documents of a task, in their order, are one stream of token ids.  Window
cuts may stand at document ends (free), sentence ends (a small penalty) and,
inside a stretch of more than ``FORCED`` ids without either, at every
``FORCED``-th id (a larger penalty).  f[j] = penalty[j] + min over i of f[i] +
padding(j - i); padding is linear in the window's length, so the minimum over
the last ``size`` ids is a sliding-window minimum kept in a monotone queue;
windows of a power of two ids have no padding and are tried besides.

The stream is solved in stretches of about ``STRETCH`` ids; the last window of
a stretch is not closed but opens the next one, so memory stays bounded and
only a task's last sequence may be mostly padding.

Nulls: a null text is empty (only its end id); null doc_id stays null.  Rows
that repeat a doc_id are documents of their own.  Sequence ids hold the
partition in their upper bits, so a task that runs again gives the same ids.
Other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SIZE, END_ID = 1024, 0
#: In ids of padding that a cut is worth.
SENTENCE_PENALTY, FORCED_PENALTY, WINDOW_COST = 4, 48, 2
#: Sentence cuts stand in different stretches of SPACING ids, forced ones FORCED ids apart; less of both in windows of under 1024 ids.
SPACING, FORCED = 24, 256
STRETCH = 400_000
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """The ids of a byte-level BPE .json by tokenizers.

    The same vocabulary as tiktoken ranks, if given, takes the texts whose
    characters are all below U+02C0, where both libraries agree on character
    classes; tokenizers takes the rest.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None):
        import tokenizers

        self.hf = tokenizers.Tokenizer.from_file(json_path)
        self.fast = None
        self.special = {t.content: i for i, t in self.hf.get_added_tokens_decoder().items()}
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        vocab = self.hf.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            # byte-level pieces write a line break as U+010A
            self.ends[i] = piece[-1:] in (".", "!", "?") or "Ċ" in piece

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and (text.isascii() or max(text) < "ˀ"):
            return self.fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32)
        return np.array(self.hf.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(json_path: str, ranks_path: str | None = None) -> Encoder:
    if json_path not in _encoders:
        _encoders[json_path] = Encoder(json_path, ranks_path)
    return _encoders[json_path]


def cut_places(doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window of ``size`` ids may end, ascending, and what each costs; none is further than ``size`` from the one before."""
    spacing, forced = min(SPACING, max(size // 16, 1)), min(FORCED, max(size // 4, 1))
    is_doc = np.isin(sentence_ends, doc_ends, assume_unique=True)
    s = sentence_ends[~is_doc]
    keep = np.zeros(len(s), bool)
    if len(s):  # the first sentence end of each stretch of spacing ids, and none close to a document's end
        cell = s // spacing
        keep[0] = True
        keep[1:] = cell[1:] != cell[:-1]
        nxt = doc_ends[np.minimum(np.searchsorted(doc_ends, s), len(doc_ends) - 1)]
        keep &= nxt - s >= spacing
    at = np.concatenate([doc_ends, s[keep]])
    cost = np.concatenate([np.zeros(len(doc_ends), np.int64), np.full(int(keep.sum()), SENTENCE_PENALTY, np.int64)])
    order = np.argsort(at, kind="stable")
    at, cost = at[order], cost[order]
    gap = np.diff(at, prepend=0)
    wide = np.flatnonzero(gap > forced)
    if len(wide):
        more = np.concatenate([np.arange(at[k] - gap[k] + forced, at[k], forced) for k in wide.tolist()])
        at = np.concatenate([at, more])
        cost = np.concatenate([cost, np.full(len(more), FORCED_PENALTY, np.int64)])
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    return at, cost


def best_cuts(at: np.ndarray, cost: np.ndarray, size: int = SIZE) -> list[int]:
    """The places, of ``at``, where windows end at the least total of padding and penalties."""
    pos = [0, *at.tolist()]
    pen = [0, *cost.tolist()]
    n = len(pos)
    f, back = [0] * n, [0] * n
    where = {0: 0}
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f[i] + pos[i], i), ascending
    halves = [size >> k for k in (1, 2, 3) if size >> k]
    power = size & (size - 1) == 0
    for j in range(1, n):
        p = pos[j]
        low = p - size
        while pos[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        best = value + size - p
        if power:
            for h in halves:
                k = where.get(p - h)
                if k is not None and f[k] < best:
                    best, i = f[k], k
        v = best + pen[j] + WINDOW_COST
        f[j], back[j] = v, i
        where[p] = j
        v += p
        while queue and queue[-1][0] >= v:
            queue.pop()
        queue.append((v, j))
    cuts = []
    j = n - 1
    while j:
        cuts.append(pos[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """Takes documents in order and gives pieces: (row, start, length, crc32, document's ids, sequence, offset)."""

    def __init__(self, ends: np.ndarray, size: int = SIZE, first_sequence: int = 0):
        self.ends, self.size, self.next = ends, size, first_sequence
        self.parts: list[tuple[object, np.ndarray, int]] = []  # (row, ids left, ids before them)
        self.held = 0

    def add(self, row: object, ids: np.ndarray) -> list[tuple]:
        self.parts.append((row, ids, 0))
        self.held += len(ids)
        return self.solve(False) if self.held >= STRETCH else []

    def solve(self, last: bool) -> list[tuple]:
        if not self.parts:
            return []
        ids = np.concatenate([p[1] for p in self.parts])
        ends = np.cumsum([len(p[1]) for p in self.parts])
        sentence = np.flatnonzero(self.ends[ids]) + 1
        cuts = best_cuts(*cut_places(ends, sentence, self.size), self.size)
        if not last:
            cuts = cuts[:-1]
        done = cuts[-1] if cuts else 0
        out = []
        if done:
            raw = memoryview(ids.astype("<u4").tobytes())
            edges = np.union1d(cuts, ends[ends < done])
            starts = np.concatenate([[0], edges[:-1]])
            doc = np.searchsorted(ends, starts, "right")
            window = np.searchsorted(cuts, starts, "right")
            begin = np.concatenate([[0], cuts])[window]
            for a, b, d, w, o in zip(starts.tolist(), edges.tolist(), doc.tolist(), window.tolist(), (starts - begin).tolist(), strict=True):
                row, part, before = self.parts[d]
                at = int(ends[d]) - len(part)
                out.append((row, before + a - at, b - a, zlib.crc32(raw[4 * a : 4 * b]), before + len(part), self.next + w, o))
            self.next += len(cuts)
        left = []
        for (row, part, before), end in zip(self.parts, ends.tolist(), strict=True):
            if end > done:
                skip = max(0, done - (end - len(part)))
                left.append((row, part[skip:], before + skip))
        self.parts, self.held = left, len(ids) - done
        return out


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, size: int = SIZE) -> DataFrame:
    """docs(doc_id, text) -> a row for each piece of a document in a sequence of at most ``size`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(json_path, ranks_path)
        context = TaskContext.get()
        packer = Packer(e.ends, size, (context.partitionId() if context else 0) << 40)

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], NAMES)

        end = np.array([END_ID], np.uint32)
        for b in batches:
            for row, text in zip(b.column(0), b.column(1), strict=True):
                yield from out(packer.add(row.as_py(), np.concatenate([e.ids(text.as_py() or ""), end])))
        yield from out(packer.solve(True))

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)

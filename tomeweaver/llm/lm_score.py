"""Document scores by a gated recurrent language model.

Tokens are lower-cased words and one end for each document.  Word counts cover
all training documents: tasks count by 64-bit word hash, and packed partial
counts are dealt by hash and summed.  The network's tokens are the end, the most
frequent words, and ``BUCKETS`` endings: every other word is the token of its last
two bytes, so that the network predicts which kind of rare word comes, and sees
which one came; its own share within that kind comes from its count (add one), so
the model is a distribution over all words.  The network is a GRU whose output softmax is factored into classes
of words of like frequency, trained in numpy by truncated backpropagation.

Training documents are cut into pieces of at most ``PIECE`` tokens, and the pieces dealt by a hash of id and words to
trainers, about ``TRAINER`` tokens each, and to ``ROUNDS`` rounds.  A bounded sample of pieces gives all trainers the same
start.  In each round every trainer goes on from the same network over its pieces of that round, and the
networks are averaged by tokens, in a tree of ``FAN`` a group.  So what is learned depends on the documents and not on
how files hold them, but for rounding.
When scoring, the state is carried from window to window to a document's end,
so a score is the whole document's.

Counts of the ``FREQUENT`` most frequent words go to all tasks (a bounded
table); tokens of other words are dealt by hash in packed blocks to where their
counts are, and come back as sums for each document.

Nulls: null text is empty (only its end), null doc_id stays null and its row
counts as the caller's conditions say (null is false).  Without training documents all counts are 0 and the
network is untrained.  Repeated rows each get a row and are trained on each time; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .store import shuffle_partitions, written

U = np.uint64
#: Words whose counts every task holds; endings of other words; words of the network; words of a class; hidden units.
FREQUENT, BUCKETS, VOCABULARY, CLASS, HIDDEN = 65536, 64, 4032, 64, 16
#: Tokens (about) that the network starts from; passes over them; lanes and steps of a window.
SAMPLE, EPOCHS, LANES, WINDOW = 300_000, 2, 64, 32
#: Tokens of a piece, of a trainer (about); rounds of training and averaging; networks averaged at a time.
PIECE, TRAINER, ROUNDS, FAN = 16384, 3_000_000, 2, 16
#: Of a trainer: lanes, first rate, tokens trained on at a time.
TASK_LANES, TASK_RATE, TASK_TOKENS = 256, 0.005, 1 << 18
END, SPECIAL = 0, 1
#: Logits are held within this on both sides, so that no softmax needs its maximum.
BOUND = 60.0
SLICE = 12 << 20
FLUSH = 3_000_000


def word_keys(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of every lower-cased word (its hash, the lowest bits replaced by its ending's number), and the index of each document's first word (n + 1)."""
    low = tb.LOWER[data]
    s, e, first = tb.spans(low, off, tb.WORD)
    if not len(s):
        return np.zeros(0, U), first
    ending = low[e - 1].astype(U) * U(251) + np.where(e - s > 1, low[np.maximum(e - 2, 0)], 0).astype(U)
    return (tb.hashes(low, s, e) & ~U(BUCKETS - 1)) | (tb.mix(ending) & U(BUCKETS - 1)), first


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return (keys & U(BUCKETS - 1)).astype(np.int64)


def dealt(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U(32)) % U(parts)).astype(np.int64)


def _packed(h: np.ndarray, c: np.ndarray, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    p = dealt(h, parts)
    order = np.argsort(p, kind="stable")
    h, c = h[order], c[order]
    cut = np.searchsorted(p[order], np.arange(parts + 1))
    for k in range(parts):
        if cut[k] < cut[k + 1]:
            yield k, h[cut[k] : cut[k + 1]].tobytes(), c[cut[k] : cut[k + 1]].tobytes()


def _summed(hs: list[np.ndarray], cs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h = np.concatenate(hs) if hs else np.zeros(0, U)
    c = np.concatenate(cs) if cs else np.zeros(0, np.int64)
    u, inverse = np.unique(h, return_inverse=True)
    return u, np.bincount(inverse, weights=c, minlength=len(u)).astype(np.int64)


def kinds_of(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Tokens and words of each ending (2 x BUCKETS)."""
    b = bucket_of(keys)
    return np.stack([np.bincount(b, weights=counts, minlength=BUCKETS), np.bincount(b, minlength=BUCKETS)]).astype(np.int64)


def word_counts(train: DataFrame, parts: int) -> DataFrame:
    """(p, h, c, words, tokens, docs, kinds): packed sorted keys and counts of part p; documents on one row of each task; kinds: of each ending the tokens and words, packed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["p", "h", "c", "docs"]

        def flush(hs: list, cs: list, docs: int) -> pa.RecordBatch:
            rows = list(_packed(*_summed(hs, cs), parts))
            # the documents of a task without words go with any part
            rows = rows or [(0, b"", b"")]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()), pa.array([docs] + [0] * (len(rows) - 1), pa.int64())], names)

        hs, cs, docs, held = [], [], 0, 0
        for b in batches:
            for i, j, data, off in tb.slices(b.column(0)):
                u, c = np.unique(word_keys(data, off)[0], return_counts=True)
                hs.append(u)
                cs.append(c)
                docs += j - i
                held += len(u)
                if held > FLUSH:
                    yield flush(hs, cs, docs)
                    hs, cs, docs, held = [], [], 0, 0
        if docs:
            yield flush(hs, cs, docs)

    def add(t: pa.Table) -> pa.Table:
        h, c = _summed([np.frombuffer(x.as_py(), U) for x in t.column("h")], [np.frombuffer(x.as_py(), np.int64) for x in t.column("c")])
        return pa.table({"p": pa.array([t.column("p")[0].as_py()], pa.int32()), "h": pa.array([h.tobytes()], pa.binary()), "c": pa.array([c.tobytes()], pa.binary()), "words": pa.array([len(h)], pa.int64()), "tokens": pa.array([int(c.sum())], pa.int64()), "docs": pa.array([sum(t.column("docs").to_pylist())], pa.int64()), "kinds": pa.array([kinds_of(h, c).tobytes()], pa.binary())})

    return train.select("text").mapInArrow(count, "p int, h binary, c binary, docs long").groupBy("p").applyInArrow(add, "p int, h binary, c binary, words long, tokens long, docs long, kinds binary")


def most_frequent(counts: DataFrame, parts: int, n: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of about ``n`` most frequent words, by falling count: each part sends its own, four times its share at most."""
    each = max(64, 4 * n // parts)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, c in zip(b.column(0), b.column(1), strict=True):
                h, c = np.frombuffer(h.as_py(), U), np.frombuffer(c.as_py(), np.int64)
                order = np.lexsort((h, -c))[:each]
                yield pa.RecordBatch.from_arrays([pa.array([h[order].tobytes()], pa.binary()), pa.array([c[order].tobytes()], pa.binary())], ["h", "c"])

    rows = counts.select("h", "c").mapInArrow(top, "h binary, c binary").collect()
    h = np.concatenate([np.frombuffer(r.h, U) for r in rows] or [np.zeros(0, U)])
    c = np.concatenate([np.frombuffer(r.c, np.int64) for r in rows] or [np.zeros(0, np.int64)])
    order = np.lexsort((h, -c))[:n]
    return h[order], c[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-x))


@dataclass
class Network:
    """x: input projections of each token (tokens x 3H); u: recurrent (H x 3H); wc, bc: classes; ww, bw: words of each class."""

    x: np.ndarray
    u: np.ndarray
    wc: np.ndarray
    bc: np.ndarray
    ww: np.ndarray
    bw: np.ndarray

    @property
    def params(self) -> list[np.ndarray]:
        return [self.x, self.u, self.wc, self.bc, self.ww, self.bw]

    def step(self, h: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
        n = h.shape[1]
        x = self.x.take(tokens, 0)
        a = h @ self.u
        zr = _sigmoid(np.clip(x[:, : 2 * n] + a[:, : 2 * n], -20, 20))
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(x[:, 2 * n :] + r * a[:, 2 * n :])
        return c + z * (h - c), z, r, c, a[:, 2 * n :]

    def log_probs(self, h: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Natural logarithm of each token's probability in its state: class, then word of the class."""
        cls = class_of(tokens)
        logits = np.clip(h @ self.wc + self.bc, -BOUND, BOUND)
        out = logits[np.arange(len(cls)), cls] - np.log(np.exp(logits) @ np.ones(len(self.bc), h.dtype))
        order, cut = by_class(cls, len(self.bc))
        hs, ws, inner, one = h[order], ((tokens - SPECIAL) % CLASS)[order], np.zeros(len(order), h.dtype), np.ones(CLASS, h.dtype)
        for k in range(len(self.bc) - SPECIAL):
            a, b = cut[k], cut[k + 1]
            if a < b:
                lg = np.clip(hs[a:b] @ self.ww[k] + self.bw[k], -BOUND, BOUND)
                inner[a:b] = lg[np.arange(b - a), ws[a:b]] - np.log(np.exp(lg) @ one)
        out[order] += inner
        return out


def class_of(tokens: np.ndarray) -> np.ndarray:
    return np.where(tokens < SPECIAL, tokens, (tokens - SPECIAL) // CLASS + SPECIAL)


def by_class(cls: np.ndarray, classes: int) -> tuple[np.ndarray, list[int]]:
    """Order of tokens by class, and where the first token of each class of words stands in it."""
    cls = cls.astype(np.int16)
    order = np.argsort(cls, kind="stable")
    return order, np.searchsorted(cls[order], np.arange(SPECIAL, classes + 1)).tolist()


def new_network(counts: np.ndarray, ends: int, hidden: int = HIDDEN) -> Network:
    """Starts as the unigram model of these counts (of endings, then words); a class's missing words get no probability."""
    rng = np.random.default_rng(11)
    classes = -(-len(counts) // CLASS)
    words = np.zeros(classes * CLASS)
    words[: len(counts)] = counts
    per = words.reshape(classes, CLASS) if classes else np.zeros((0, CLASS))
    bc = np.log(np.concatenate([[ends], per.sum(1)]) + 0.5)
    bw = np.where(np.arange(classes * CLASS).reshape(per.shape) < len(counts), np.log(np.maximum(per, 0.5)), -30.0)
    f = np.float32
    return Network((rng.normal(0, 0.1, (SPECIAL + len(words), 3 * hidden))).astype(f), (rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))).astype(f), np.zeros((hidden, len(bc)), f), bc.astype(f), np.zeros((classes, hidden, CLASS), f), bw.astype(f))


def gradients(net: Network, prev: np.ndarray, target: np.ndarray, h: np.ndarray, fresh: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Of a window's mean loss, truncated at its start; and the state at its end.  prev, target, fresh: steps x lanes."""
    (steps, lanes), n = prev.shape, h.shape[1]
    before, zs, rs, cs, rec, hs = (np.empty((steps, lanes, n), h.dtype) for _ in range(6))
    live = (~fresh).astype(h.dtype)[:, :, None]
    for t in range(steps):
        before[t] = h * live[t]
        h, zs[t], rs[t], cs[t], rec[t] = net.step(before[t], prev[t])
        hs[t] = h
    flat, tok = hs.reshape(-1, n), target.ravel()
    m = len(tok)
    cls = class_of(tok)
    p = np.exp(np.clip(flat @ net.wc + net.bc, -BOUND, BOUND))
    p /= (p @ np.ones(p.shape[1], p.dtype))[:, None]
    loss = -np.log(p[np.arange(m), cls] + 1e-30).sum()
    p[np.arange(m), cls] -= 1
    p /= m
    dwc, dbc, dflat = flat.T @ p, p.sum(0), p @ net.wc.T
    dww, dbw = np.zeros_like(net.ww), np.zeros_like(net.bw)
    order, cut = by_class(cls, len(net.bc))
    fs, ws, ds, one = flat[order], ((tok - SPECIAL) % CLASS)[order], dflat[order], np.ones(CLASS, flat.dtype)
    for k in range(len(net.bc) - SPECIAL):
        a, b = cut[k], cut[k + 1]
        if a < b:
            q = np.exp(np.clip(fs[a:b] @ net.ww[k] + net.bw[k], -BOUND, BOUND))
            q /= (q @ one)[:, None]
            own = np.arange(b - a)
            loss -= np.log(q[own, ws[a:b]] + 1e-30).sum()
            q[own, ws[a:b]] -= 1
            q /= m
            dww[k], dbw[k] = fs[a:b].T @ q, q.sum(0)
            ds[a:b] += q @ net.ww[k].T
    dflat[order] = ds
    dhs = dflat.reshape(steps, lanes, n)
    # what a gate's gradient is for a unit of the state's, for all steps at once
    by_z, by_c, by_r = (before - cs) * zs * (1 - zs), (1 - zs) * (1 - cs * cs), rec * rs * (1 - rs)
    das, dcs = np.empty((steps, lanes, 3 * n), h.dtype), np.empty((steps, lanes, n), h.dtype)
    dh, ut = np.zeros_like(h), np.ascontiguousarray(net.u.T)
    for t in reversed(range(steps)):
        dh += dhs[t]
        np.multiply(dh, by_z[t], out=das[t, :, :n])
        np.multiply(dh, by_c[t], out=dcs[t])
        np.multiply(dcs[t], by_r[t], out=das[t, :, n : 2 * n])
        np.multiply(dcs[t], rs[t], out=das[t, :, 2 * n :])
        dh *= zs[t]
        dh += das[t] @ ut
        dh *= live[t]
    das = das.reshape(-1, 3 * n)
    du = before.reshape(-1, n).T @ das
    das[:, 2 * n :] = dcs.reshape(-1, n)  # inputs reach the candidate past the reset gate
    dx = np.zeros_like(net.x)
    order = np.argsort(prev.ravel().astype(np.uint16), kind="stable")
    begin = np.flatnonzero(np.diff(prev.ravel()[order], prepend=-1))
    dx[prev.ravel()[order[begin]]] = np.add.reduceat(das[order], begin)
    return [dx, du, dwc, dbc, dww, dbw], h, float(loss) / m


class Adam:
    """Steps of Adam on a network's parameters; gradients are held at norm 1, the rate falls with the square root of steps / ``slow``."""

    def __init__(self, net: Network, rate: float, slow: float = float("inf")):
        self.net, self.rate, self.slow, self.n = net, rate, slow, 0
        self.m, self.v = [np.zeros_like(p) for p in net.params], [np.zeros_like(p) for p in net.params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.n += 1
        rate = self.rate / (1 + self.n / self.slow) ** 0.5
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        for p, g, a, b in zip(self.net.params, grads, self.m, self.v, strict=True):
            g = g * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= (rate * a / (1 - 0.9**self.n) / (np.sqrt(b / (1 - 0.999**self.n)) + 1e-8)).astype(np.float32)


def train_network(net: Network, docs: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01, lanes: int = LANES, adam: Adam | None = None) -> list[float]:
    """Windows of lanes: the pieces stand one behind the other in a stream that lanes share evenly; a state is carried from window to window, and what follows an END begins with a fresh one."""
    if not docs:
        return []
    stream = np.concatenate(docs).astype(np.int64)
    lanes = min(lanes, max(1, len(stream) // WINDOW))
    steps = -(-len(stream) // lanes)
    # the last lane is filled from the stream's start
    target = np.resize(stream, lanes * steps).reshape(lanes, steps).T
    prev = np.resize(np.concatenate([[END], stream[:-1]]), lanes * steps).reshape(lanes, steps).T
    fresh = prev == END
    adam, losses = adam or Adam(net, rate), []
    for _ in range(epochs):
        h = np.zeros((lanes, net.u.shape[0]), net.u.dtype)
        for s in range(0, steps, WINDOW):
            grads, h, loss = gradients(net, prev[s : s + WINDOW], target[s : s + WINDOW], h, fresh[s : s + WINDOW])
            losses.append(loss)
            adam.step(grads)
    return losses


def packed_network(net: Network) -> bytes:
    return np.concatenate([p.ravel() for p in net.params]).astype(np.float32).tobytes()


def unpacked_network(raw: bytes, like: Network) -> Network:
    flat, at, out = np.frombuffer(raw, np.float32), 0, []
    for p in like.params:
        out.append(flat[at : at + p.size].reshape(p.shape).copy())
        at += p.size
    return Network(*out)


@dataclass
class Vocabulary:
    """Sorted keys of the frequent words, their counts, and the network's token of each (its ending's for most)."""

    keys: np.ndarray
    counts: np.ndarray
    tokens: np.ndarray

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each key (-1: not frequent) and its token."""
        at = tb.lookup(self.keys, keys)
        ending = SPECIAL + bucket_of(keys)
        return at, np.where(at < 0, ending, self.tokens[at]) if len(self.keys) else ending


#: Hashes that pick a sample are compared as numbers below this.
RANGE = 1 << 40


def pieces(rows: DataFrame, vocabulary: Vocabulary, trainers: int) -> DataFrame:
    """rows(doc_id, text) as pieces: trainer, round, h (a hash of id, words and place), n, w (tokens, packed; a document's last piece ends in END)."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by FREQUENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        times: dict[int, int] = {}  # rows that repeat id and words go to different trainers
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, _, data, off in tb.slices(b.column(1)):
                keys, first = word_keys(data, off)
                token = v.look(keys)[1].astype("<u2")
                out = []
                for k, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    name = ((ids[i + k] or 0) * 0x9E3779B97F4A7C15 + y - x + int(tb.mix(keys[x:y] + np.arange(y - x, dtype=U)).sum())) & (2**64 - 1)
                    if len(times) > 100_000:
                        times.clear()
                    times[name] = t = times.get(name, -1) + 1
                    whole = np.append(token[x:y], np.uint16(END))
                    for n, a in enumerate(range(0, len(whole), PIECE)):
                        h = int(tb.mix(np.array([(name + n * 0x165667B19E3779F9 + t * 0xC2B2AE3D27D4EB4F) & (2**64 - 1)], U))[0])
                        part = whole[a : a + PIECE]
                        out.append(((h >> 8) % trainers, h % ROUNDS, h >> 1, len(part), part.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["trainer", "round", "h", "n", "w"])

    return rows.select("doc_id", "text").mapInArrow(run, "trainer int, round int, h long, n long, w binary")


def _tokens(t: pa.Table) -> list[np.ndarray]:
    """Tokens of the pieces of a group, in the order of their hashes."""
    t = t.sort_by([("h", "ascending"), ("w", "ascending")])
    return [np.frombuffer(w.as_buffer(), "<u2").astype(np.int64) for c in t.column("w").chunks for w in c]


NETS, NET_NAMES = "p long, n long, w binary", ["p", "n", "w"]


def _net_row(p: int, n: int, net: Network) -> pa.Table:
    return pa.table({"p": pa.array([p], pa.int64()), "n": pa.array([n], pa.int64()), "w": pa.array([packed_network(net)], pa.binary())})


def started(table: DataFrame, net: Network, tokens: int, sample: int = SAMPLE) -> Network:
    """``net`` trained on the pieces of lowest hash, about ``sample`` of all ``tokens``, in one task."""
    shared = table.sparkSession.sparkContext.broadcast(net)
    some = table.where(F.pmod(F.xxhash64("h"), F.lit(RANGE)) < min(RANGE, RANGE * sample // max(tokens, 1)))

    def train(t: pa.Table) -> pa.Table:
        own = Network(*(p.copy() for p in shared.value.params))
        train_network(own, _tokens(t))
        return _net_row(0, t.num_rows, own)

    got = some.groupBy(F.lit(1).alias("one")).applyInArrow(train, NETS).collect()  # one network
    return unpacked_network(got[0].w, net) if got else net


def train_round(table: DataFrame, net: Network) -> Network:
    """``net`` trained on by each trainer over its pieces in ``table``, and averaged by tokens."""
    shared = table.sparkSession.sparkContext.broadcast(net)  # bounded by VOCABULARY

    def train(t: pa.Table) -> pa.Table:
        own = Network(*(p.copy() for p in shared.value.params))
        adam = Adam(own, TASK_RATE, 64)
        docs, held, n = [], 0, 0
        for x in _tokens(t):
            docs.append(x)
            held += len(x)
            if held >= TASK_TOKENS:
                train_network(own, docs, 1, lanes=TASK_LANES, adam=adam)
                docs, held, n = [], 0, n + held
        if docs:
            train_network(own, docs, 1, lanes=TASK_LANES, adam=adam)
        return _net_row(t.column("trainer")[0].as_py(), n + held, own)

    def average(t: pa.Table) -> pa.Table:
        t = t.sort_by("p")
        n = np.array(t.column("n").to_pylist(), np.int64)
        total = sum(k * np.frombuffer(w.as_py(), np.float32).astype(np.float64) for k, w in zip(n.tolist(), t.column("w"), strict=True))
        return _net_row(t.column("p")[0].as_py() // FAN, int(n.sum()), unpacked_network((total / n.sum()).astype(np.float32).tobytes(), shared.value))

    nets = written(table.groupBy("trainer").applyInArrow(train, NETS), "networks")
    while len(got := nets.limit(2).collect()) > 1:
        nets = written(nets.groupBy(F.floor(F.col("p") / FAN)).applyInArrow(average, NETS), "networks")
    return unpacked_network(got[0].w, net) if got else net


def trained(rows: DataFrame, net: Network, vocabulary: Vocabulary, tokens: int) -> Network:
    """``net`` trained on all rows(doc_id, text), which hold so many ``tokens``."""
    table = written(pieces(rows, vocabulary, max(1, -(-tokens // TRAINER))), "lm-pieces")
    net = started(table, net, tokens)
    for r in range(ROUNDS):
        net = train_round(table.where(F.col("round") == r), net)
    return net


def score_documents(net: Network, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each document: tokens first[i] to first[i + 1], the last of them END."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    length, begin = length[order], first[:-1][order]
    total = np.zeros(len(order))
    h = np.zeros((len(order), net.u.shape[0]), np.float32)
    t = 0
    while len(length) and t < length[0]:
        live = int(np.searchsorted(-length, -t, "left"))  # documents with more than t tokens
        steps = int(min(max(WINDOW, 16384 // live), length[0] - t, 512))
        h = h[:live]
        at = begin[:live] + np.minimum(t + np.arange(steps)[:, None], length[:live] - 1)
        prev = np.where((t + np.arange(steps) == 0)[:, None], END, tokens[np.maximum(at - 1, 0)])
        hs = np.empty((steps, live, h.shape[1]), np.float32)
        for k in range(steps):
            h = net.step(h, prev[k])[0]
            hs[k] = h
        ok = (t + np.arange(steps))[:, None] < length[:live]
        step, doc = np.nonzero(ok)
        for a in range(0, len(step), 1 << 16):
            s, d = step[a : a + (1 << 16)], doc[a : a + (1 << 16)]
            total[:live] += np.bincount(d, weights=net.log_probs(hs[s, d], tokens[at[s, d]]), minlength=live)
        t += steps
    out = np.zeros(len(order))
    out[order] = total
    return out


@dataclass
class Model:
    net: Network
    vocabulary: Vocabulary
    n: int
    v: int
    ends: int
    rest: np.ndarray  # of each ending, log10 of what the counts (plus one) of its words outside the network, and of one new word, sum up to


def fit(docs: DataFrame, train: Column, parts: int | None = None) -> tuple[Model, DataFrame]:
    """The model, and the table of all counts in the shared folder."""
    parts = parts or shuffle_partitions(docs.sparkSession)
    rows = docs.where(train)
    counts = written(word_counts(rows, parts), "word-counts")
    total = counts.agg(F.sum("words").alias("v"), F.sum("tokens").alias("n"), F.sum("docs").alias("d")).first()
    v, n, ends = total.v or 0, total.n or 0, total.d or 0
    kinds = sum((np.frombuffer(r.kinds, np.int64).reshape(2, BUCKETS) for r in counts.select("kinds").collect()), np.zeros((2, BUCKETS), np.int64))  # a kilobyte a part
    h, c = most_frequent(counts, parts)
    kinds = kinds - kinds_of(h[:VOCABULARY], c[:VOCABULARY])
    net = new_network(np.concatenate([kinds[0], c[:VOCABULARY]]), ends)
    order = np.argsort(h)
    tokens = np.where(order < VOCABULARY, SPECIAL + BUCKETS + order, SPECIAL + bucket_of(h[order]))
    words = Vocabulary(h[order], c[order], tokens)
    net = trained(rows, net, words, n + ends)
    return Model(net, words, n + ends, v + (ends > 0), ends, np.log10(kinds.sum(0) + 1.0)), counts


#: A document's sums: as an array of records, packed into one binary value for each block of documents.
RECORD = np.dtype([("doc", "<i4"), ("known", "<i8"), ("log", "<f8")])
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_score(docs: DataFrame, held_out: Column, model: Model, counts: DataFrame, parts: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> each document's tokens, known tokens, unigram base score and the network's log10 probability."""
    spark = docs.sparkSession
    parts = parts or shuffle_partitions(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded: FREQUENT counts and the network
    mid = "p int, block long, docs binary, h binary, d binary"
    names = ["p", "block", "docs", "h", "d"]
    doc_type = np.dtype([("id", "<i8"), ("null", "?"), ("held", "?"), ("n", "<i8"), ("known", "<i8"), ("log", "<f8"), ("outside_log", "<f8"), ("net", "<f8")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 32
        for b in batches:
            for i, j, data, off in tb.slices(b.column(2), SLICE):
                h, first = word_keys(data, off)
                n = j - i
                doc = np.repeat(np.arange(n), np.diff(first))
                at, token = m.vocabulary.look(h)
                seen = at >= 0
                log = np.where(seen, np.log10((m.vocabulary.counts[at] if len(m.vocabulary.counts) else 0) + 1.0), 0.0)
                x = np.insert(token, first[1:], END)
                bounds = first + np.arange(n + 1)
                rec = np.zeros(n, doc_type)
                ids = b.column(0).slice(i, n).cast(pa.int64())
                rec["id"], rec["null"] = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
                rec["held"] = b.column(1).slice(i, n).to_numpy(zero_copy_only=False)
                rec["n"] = np.diff(first) + 1
                rec["known"] = np.bincount(doc, weights=seen, minlength=n) + (m.ends > 0)
                rec["log"] = np.bincount(doc, weights=log, minlength=n) + np.log10(m.ends + 1.0)
                outside = token < SPECIAL + BUCKETS
                rec["outside_log"] = np.bincount(doc, weights=np.where(outside, log - m.rest[bucket_of(h)], 0), minlength=n)
                rec["net"] = score_documents(m.net, x, bounds) / np.log(10)
                rare = np.flatnonzero(~seen)
                rows = [(((block >> 32) * 31 + (block & 0xFFFFFFFF)) % parts, block, rec.tobytes(), b"", b""), *((p, block, b"", a, c) for p, a, c in _packed(h[rare], doc[rare].astype("<i4"), parts))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names)
                block += 1

    def count(tokens: pa.Table, known: pa.Table) -> pa.Table:
        if known.num_rows:
            h, c = np.frombuffer(known.column("h")[0].as_py(), U), np.frombuffer(known.column("c")[0].as_py(), np.int64)
        else:
            h, c = np.zeros(0, U), np.zeros(0, np.int64)
        out: list[tuple[int, bytes, bytes]] = []
        for block, docs_, x, d in zip(*(tokens.column(k).to_pylist() for k in names[1:]), strict=True):
            if docs_:
                out.append((block, docs_, b""))
                continue
            x, d = np.frombuffer(x, U), np.frombuffer(d, "<i4")
            at = tb.lookup(h, x)
            hit = at >= 0
            u, inverse = np.unique(d, return_inverse=True)
            rec = np.zeros(len(u), RECORD)
            rec["doc"] = u
            rec["known"] = np.bincount(inverse, weights=hit, minlength=len(u))
            rec["log"] = np.bincount(inverse, weights=np.where(hit, np.log10((c[at] if len(c) else 0) + 1.0), 0), minlength=len(u))
            rec = rec[rec["known"] > 0]
            if len(rec):
                out.append((block, b"", rec.tobytes()))
        return pa.table({"block": pa.array([r[0] for r in out], pa.int64()), "docs": pa.array([r[1] for r in out], pa.binary()), "part": pa.array([r[2] for r in out], pa.binary())})

    def finish(t: pa.Table) -> pa.Table:
        m: Model = shared.value
        rec = np.frombuffer(next(x for x in t.column("docs").to_pylist() if x), doc_type).copy()
        for x in t.sort_by("part").column("part").to_pylist():
            r = np.frombuffer(x, RECORD)
            rec["known"][r["doc"]] += r["known"]
            rec["log"][r["doc"]] += r["log"]
            rec["outside_log"][r["doc"]] += r["log"]
        base = rec["log"] - rec["n"] * np.log10(m.n + m.v + 1.0)
        score = rec["net"] + rec["outside_log"]
        return pa.table({"doc_id": pa.array(rec["id"], pa.int64(), mask=rec["null"]), "held_out": pa.array(rec["held"]), "n_tokens": pa.array(rec["n"]), "n_known": pa.array(rec["known"]), "train_tokens": pa.array(np.full(len(rec), m.n, np.int64)), "base_score": pa.array(base), "score": pa.array(score)})

    dealt_tokens = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_"), "text").mapInArrow(scan, mid)
    parts_of = dealt_tokens.groupBy("p").cogroup(counts.select("p", "h", "c").groupBy("p")).applyInArrow(count, "block long, docs binary, part binary")
    return parts_of.groupBy("block").applyInArrow(finish, SCHEMA)

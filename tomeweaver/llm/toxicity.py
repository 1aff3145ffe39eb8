"""Toxicity by class-conditional Kneser-Ney models.

Two Kneser-Ney models of words by continuation counts, one of toxic and one of ordinary texts: a word counts once for
each different word before it, so neither copies nor a phrase that one text repeats weigh more.  Each level takes an
absolute discount that is estimated from its counts of counts, n1 / (n1 + 2 n2), and gives what it took to the next:
words of the class, then words that both classes share, then one share for any word.  The shared level counts a word
once for each class that has it (a continuation count with classes as contexts).  So a rare expression of one class is
smoothed to nearly the same probability in both, and a frequent expression of one class is not given back to the other.
A level of pairs of words above these lost toxic texts when tried (README), as a pair is nearly always new.

A text's measure is the log-likelihood ratio of the whole text, divided by its number of words; no word is left out.
A toxic text has mostly ordinary words, so its model is an interpolation too: a share of the toxic class's model and the
rest of the ordinary one's, against the ordinary one's alone.  A word that one class happens to show a little more
often, as those of a language do, so moves the ratio by no more than that share, and a hundred of them do not drown two
toxic ones, as they do with a share of 1 (README).  A logistic map of that one number, fitted on labelled texts that the
models have not seen, gives the probability of the toxic label; the share (of ``SHARES``) is the one under which those
labels are likeliest.

Learning takes a bounded sample of the labelled rows (about ``SAMPLE`` texts of each class for the models and
``CALIBRATION`` for the map, of at most ``LONGEST`` bytes each); the map's constant is then set for the classes' shares
among all labelled rows.  A class whose rows all fall to the models or all to the map serves both with them.

Nulls: null text is empty and scores as such, null doc_id stays null, rows with a
null label are not learned from.  Without both classes to learn from every
score is the share of toxic rows among those labelled (0 without any).
Repeated rows each get a row, and are learned from once; an id with many texts or labels gives no more than its share
of the sample; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb

#: Bounds on the labelled sample: texts of each class for the models, and for the map, and bytes of such a text.
SAMPLE, CALIBRATION, LONGEST = 2500, 2500, 1 << 20
#: Words whose mean ratio is a text's measure, as the end of a slice: all of them.  Read by a test only.
TELLING = None
#: Shares of the toxic class's model in a toxic text's, to choose from.
SHARES = 2.0 ** -np.arange(11)
THRESHOLD = 0.3
#: A word is ASCII letters, digits or bytes of other characters, lower-cased; so "scum!!" is "scum".
IS_WORD = tb.ALNUM
U = np.uint64


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tb.mix(a * U(0x9E3779B97F4A7C15) + b)


def discount(counts: np.ndarray) -> float:
    """The absolute discount of a level, from how many of its counts are one and two; a half if none is one."""
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    return n1 / (n1 + 2 * n2) if n1 else 0.5


def interpolated(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of a level: of entries with these counts (0: not shown by it) over those of the next level."""
    shown = counts[counts > 0]
    if not len(shown):
        return lower
    d = discount(shown)
    return (np.maximum(counts - d, 0) + d * len(shown) * lower) / shown.sum()


def continuations(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Words, and how many different words stand before each; standing first in a text counts once."""
    none = np.zeros(0, U)
    v = np.concatenate([np.concatenate([np.zeros(1, U), t[:-1]])[: len(t)] for t in texts] or [none])
    w = np.concatenate(texts or [none])
    _, once = np.unique(pair_hash(v, w), return_index=True)
    return np.unique(w[once], return_counts=True)


@dataclass
class Model:
    """Sorted words of both classes, and the toxic and the ordinary class's probability of each; the last row is of unknown words.  ``share`` is that of the toxic class's model in a toxic text's."""

    words: np.ndarray
    p: np.ndarray
    weights: np.ndarray
    prior: float
    share: float = 1.0

    @property
    def fitted(self) -> bool:
        return len(self.words) > 0


def language_models(toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """words and p of a ``Model``."""
    classes = [continuations(toxic), continuations(ordinary)]
    words, shown = np.unique(np.concatenate([w for w, _ in classes]), return_counts=True)
    shared = interpolated(np.append(shown, 0), np.full(len(words) + 1, 1 / (len(words) + 1)))
    p = np.empty((len(words) + 1, 2))
    for k, (w, n) in enumerate(classes):
        counts = np.zeros(len(words) + 1)
        counts[tb.lookup(words, w)] = n
        p[:, k] = interpolated(counts, shared)
    return words, p


def gains(m: Model) -> np.ndarray:
    """Log-likelihood ratio of each word of the model, and of unknown ones."""
    return np.log(m.share * m.p[:, 0] + (1 - m.share) * m.p[:, 1]) - np.log(m.p[:, 1])


def ratios(h: np.ndarray, m: Model) -> np.ndarray:
    """Log-likelihood ratio of each word."""
    return gains(m)[tb.lookup(m.words, h)]  # -1, the last row, for unknown words


def means(r: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text: the sum over all its words, divided by their number; 0 without words."""
    n = np.diff(first)
    return np.bincount(np.repeat(np.arange(len(n)), n), weights=r, minlength=len(n)) / np.maximum(n, 1)


def measure(h: np.ndarray, first: np.ndarray, m: Model) -> np.ndarray:
    """Of each text: the log-likelihood ratio of the whole of it, normalised by its length."""
    return means(ratios(h, m), first)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Constant and slope by Newton's method with a slight ridge on x in units of its deviation, and the labels' log-likelihood."""
    unit = x.std() or 1.0
    x = np.stack([np.ones(len(x)), x / unit], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(2), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    z = x @ w
    return w / [1, unit], float((y * z - np.logaddexp(0, z)).sum())


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(texts or [np.zeros(0, U)]), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def build(toxic: list[np.ndarray], ordinary: list[np.ndarray], held: list[np.ndarray], held_y: list[int], prior: float) -> Model:
    none = np.zeros(0, U)
    m = Model(none, np.ones((1, 2)), np.zeros(2), prior)
    if not toxic or not ordinary or not 0 < sum(held_y) < len(held_y) or not 0 < prior < 1:
        return m
    m.words, m.p = language_models(toxic, ordinary)
    if m.fitted:
        h, first = joined(held)
        at, y, best = tb.lookup(m.words, h), np.array(held_y, float), -np.inf
        for share in SHARES:
            tried = replace(m, share=share)
            weights, fits = logistic(means(gains(tried)[at], first), y)
            if fits > best:
                best, m = fits, replace(tried, weights=weights)
        k = sum(held_y)
        m.weights[0] += np.log(prior / (1 - prior)) - np.log(k / (len(held_y) - k))  # from the sample's shares to the true ones
    return m


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, and the index of each text's first word."""
    low = tb.LOWER[data]
    s, e, first = tb.spans(low, off, IS_WORD)
    return tb.hashes(low, s, e), first


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, sample: int = SAMPLE, calibration: int = CALIBRATION) -> Model:
    """labels(doc_id, toxic); ``train`` is a condition on doc_id.  The sample is those first by a hash of their id."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows if train is None else rows.where(train)
    rows = rows.select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id", F.lit(8)).alias("h_"))
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    prior = n.get(1, 0) / total if total else 0.0
    part = F.pmod("h_", F.lit(4))
    ids = rows.distinct()
    bounds = {(1, 0): sample, (0, 0): sample, (1, 1): calibration, (0, 1): calibration}  # by class, and 1 for the map
    chosen = []
    for (toxic, held), k in bounds.items():
        side = ids.where((F.col("toxic") == toxic) & ((part == 0) if held else (part != 0)))
        chosen += [(r.doc_id, toxic, held) for r in side.orderBy("h_", "doc_id").limit(k).select("doc_id").collect()]
    spark = docs.sparkSession
    picked = F.broadcast(spark.createDataFrame(sorted(chosen), "doc_id long, toxic int, held int"))  # bounded by the sample sizes
    # an id may have many rows: of a cell with more rows than its bound, a share by the rows' own hash
    times = {(r.toxic, r.held): r.n for r in docs.select("doc_id").join(picked, "doc_id").groupBy("toxic", "held").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(True)
    for (toxic, held), k in bounds.items():
        if times.get((toxic, held), 0) > k:
            of = (F.col("toxic") == toxic) & (F.col("held") == held)
            keep = keep & (~of | (F.pmod("r_", F.lit(1 << 20)) < int((1 << 20) * k / times[toxic, held])))
    some = docs.where(F.octet_length("text") <= LONGEST).select("doc_id", "text").join(picked, "doc_id")
    some = some.withColumn("r_", F.xxhash64("doc_id", "text")).where(keep).groupBy("doc_id", "toxic", "held", "r_").agg(F.first("text").alias("text")).select("toxic", "held", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in tb.slices(b.column(2)):
                h, first = word_hashes(data, off)
                packed = pa.array([h[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(2)), packed], ["toxic", "held", "w"])

    def learn(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("toxic", "held", "w")])
        of: dict[tuple[int, int], list[np.ndarray]] = {k: [] for k in bounds}
        for w, *cell in zip(*(t.column(c).to_pylist() for c in ("w", "toxic", "held")), strict=True):
            of[cell[0], cell[1]].append(np.frombuffer(w, U))
        for k in (0, 1):  # few labels may all fall to one side
            of[k, 0], of[k, 1] = of[k, 0] or of[k, 1], of[k, 1] or of[k, 0]
        m = build(of[1, 0], of[0, 0], of[1, 1] + of[0, 1], [1] * len(of[1, 1]) + [0] * len(of[0, 1]), prior)
        return pa.table({"model": pa.array([pickle.dumps(m)], pa.binary())})

    # the sample is bounded, so one task holds it; only the model comes to the driver
    got = some.mapInArrow(words, "toxic int, held int, w binary").groupBy(F.lit(1).alias("one")).applyInArrow(learn, "model binary").collect()
    return pickle.loads(got[0].model) if got else build([], [], [], [], prior)


def score_slice(data: np.ndarray, off: np.ndarray, m: Model) -> np.ndarray:
    if not m.fitted:
        return np.full(len(off) - 1, m.prior)
    return 1 / (1 + np.exp(-np.clip(m.weights[0] + m.weights[1] * measure(*word_hashes(data, off), m), -30, 30)))


SCHEMA = "doc_id long, score double, predicted int"


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score (0 to 1), predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: the sample's words and pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in tb.slices(b.column(1)):
                s = score_slice(data, off, shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that do not score as toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in tb.slices(b.column(text)):
                yield b.slice(i, j - i).filter(pa.array(score_slice(data, off, shared.value) < threshold))

    return docs.mapInArrow(run, docs.schema)

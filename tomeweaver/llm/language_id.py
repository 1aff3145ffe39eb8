"""Language ID by nearest centroid.

A text is a vector of hashed letter trigrams (sublinear TF times IDF, unit
length).  Per language, spherical k-means over a bounded sample of labelled
texts gives several centroids; the language of the centroid with the highest
cosine wins, and a text is rejected whose cosine is under the floor of the
language for texts of as many distinct trigrams: a share of a low quantile of the cosines of
training texts, and of their beginnings, that have about as many.  Odd texts that
would hold a centroid of their own have no part in one, as noise lies close to it.

The sample is of rows, not of ids: those of a language whose hash of id and text is low enough for about as many as are
wanted, each such text once.  An id or a text that stands in many rows therefore gives no more than its share, no
task gathers a language's rows, and with many languages each gives fewer texts, so that all of them stay within
``SAMPLE_ALL``; languages beyond the ``MAX_LANGS`` most frequent are not learned.

Nulls: null text or a text without letters is ``und`` with score 0 and is
rejected; null doc_id stays null; rows with a null lang are not learned from.
With nothing to learn from, every row is ``und``.  Ties between languages go to
the first by code point.  Repeated rows each get a row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb

DIMS = 4096
#: Bounds on the labelled sample: texts of each language and of all (about, as a hash picks them), and languages; centroids of each language.
SAMPLE_PER_LANG, SAMPLE_ALL, MAX_LANGS, CENTROIDS = 400, 4000, 1000, 4
#: Hashes are compared as numbers below this.
RANGE = 1 << 40
#: A text is rejected under this share of the low quantile of training cosines at its length.
MARGIN, LOW = 0.5, 0.05
#: Classes of length: the logarithm to base 2 of the number of distinct trigrams, so that a repeated phrase counts as a
#: short text; the beginnings learned from have so many bytes.
LENGTHS = 11
CUTS = [3 * 2**k // 2 for k in range(1, LENGTHS - 1)]
#: Texts that hold a centroid of a smaller share of a language's texts have no part in centroids.
MIN_SHARE = 0.02
#: Letters to bytes: ASCII letters lower-cased, bytes of other characters as they are, all else a space.
LETTER = np.full(256, 0x20, np.uint8)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
LETTER[0x80:] = np.arange(0x80, 0x100)


def count_matrix(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Trigram counts (documents x DIMS); trigrams with two or more spaces are left out."""
    n = len(off) - 1
    if len(data) < 3:
        return np.zeros((n, DIMS), np.float32)
    if n == 1 and len(data) > tb.SLICE + 2:  # a long text, by parts that share two bytes
        return sum(count_matrix(data[a : a + tb.SLICE + 2], np.array([0, min(tb.SLICE + 2, len(data) - a)])) for a in range(0, len(data) - 2, tb.SLICE))
    b = LETTER[data].astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    space = (b == 0x20).astype(np.uint8)
    ok = space[:-2] + space[1:-1] + space[2:] < 2
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))[:-2]
    last = np.zeros(len(code), bool)  # trigrams that reach into the next document
    ends = off[1:]
    for back in (1, 2):
        at = ends - back
        last[at[(at >= 0) & (at < len(code))]] = True
    ok &= ~last
    dim = (code[ok] * np.uint32(2654435761)) >> np.uint32(20)
    return np.bincount(doc[ok] * DIMS + dim, minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray  # of each centroid, an index of langs
    floor: np.ndarray  # of each language and class of length, the lowest cosine that is not rejected


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids, the first seeded by the mean and each next by the row that is furthest from all."""
    c = [unit_rows(x.mean(0, keepdims=True))[0]]
    while len(c) < min(k, len(x)):
        c.append(x[int(np.argmin((x @ np.array(c).T).max(1)))])
    c = np.array(c)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        new = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
        c = unit_rows(new)
    return c


def held_centroids(x: np.ndarray) -> np.ndarray:
    """Centroids of one language's texts; texts that make a centroid of few are left out and the others clustered again."""
    while True:
        c = spherical_kmeans(x, CENTROIDS)
        own = (x @ c.T).argmax(1)
        n = np.bincount(own, minlength=len(c))
        held = (n >= MIN_SHARE * len(x)) | (np.arange(len(c)) == n.argmax())
        if held.all() or n[held].sum() == len(x):
            return c[held]
        x = x[held[own]]


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum((counts > 0).sum(1), 1)).astype(int), LENGTHS - 1)


def floors(cos: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The lowest cosine kept in each class of length; a class without texts has that of the class below."""
    out = np.zeros(LENGTHS)
    for k in range(LENGTHS):
        own = cos[length == k]
        out[k] = MARGIN * float(np.quantile(own, LOW)) if len(own) else out[max(k - 1, 0)]
    return out


def fit(docs: DataFrame, train: Column | None = None, sample: int = SAMPLE_PER_LANG) -> Model:
    """Fits on about ``sample`` texts of each language."""
    rows = docs if train is None else docs.where(train)
    counts = rows.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    each = min(sample, SAMPLE_ALL // max(len(counts), 1))
    spark = docs.sparkSession
    cuts = F.broadcast(spark.createDataFrame([(r.lang, min(RANGE, -(-RANGE * each // r.n))) for r in counts], "cut_lang string, cut_ long"))  # MAX_LANGS rows at most
    some = rows.where(F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h_")).join(cuts, F.col("lang") == F.col("cut_lang"))
    texts = some.where(F.pmod("h_", F.lit(RANGE)) < F.col("cut_")).groupBy("lang", "h_").agg(F.first("text").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in tb.slices(b.column(1)):
                m = np.minimum(count_matrix(data, off), 60000).astype(np.uint16)
                heads = [data[x : min(y, x + CUTS[-1] + 1)].tobytes() for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([r.tobytes() for r in m], pa.binary()), pa.array(heads, pa.binary())], ["lang", "v", "head"])

    # bounded: about SAMPLE_ALL rows of some kilobytes
    got = texts.select("lang", "text").mapInArrow(vectors, "lang string, v binary, head binary").orderBy("lang", "v", "head").collect()
    langs = sorted({r.lang for r in got})
    m = np.array([np.frombuffer(r.v, np.uint16) for r in got], np.float32).reshape(-1, DIMS)
    y = np.array([langs.index(r.lang) for r in got], int)
    keep = m.sum(1) > 0
    m, y, heads = m[keep], y[keep], [r.head for r, k in zip(got, keep.tolist(), strict=True) if k]
    idf = np.log((len(m) + 1) / ((m > 0).sum(0) + 1)).astype(np.float32) + 0.1
    x = unit_rows(np.log1p(m) * idf)
    cs, owner, floor = [np.zeros((0, DIMS), np.float32)], [], np.zeros((len(langs), LENGTHS))
    for k in range(len(langs)):
        own = x[y == k]
        if len(own):
            c = held_centroids(own)
            cs.append(c)
            owner += [k] * len(c)
            cos, length = [(own @ c.T).max(1)], [length_class(m[y == k])]
            own_heads = [h for h, of in zip(heads, y.tolist(), strict=True) if of == k]
            for cut in CUTS:  # a text that ends before the cut stands among the whole ones
                begun = [h[:cut] for h in own_heads if len(h) > cut]
                b = count_matrix(np.frombuffer(b"".join(begun), np.uint8), np.concatenate([[0], np.cumsum([len(h) for h in begun], dtype=np.int64)]).astype(np.int64))
                b = b[b.sum(1) > 0]
                cos.append((unit_rows(np.log1p(b) * idf) @ c.T).max(1, initial=0))
                length.append(length_class(b))
            floor[k] = floors(np.concatenate(cos), np.concatenate(length))
    return Model(langs, idf, np.concatenate(cs).astype(np.float32), np.array(owner, int), floor)


def predict(counts: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language index, confidence (softmax over languages' best cosines) and the best cosine."""
    x = unit_rows(np.log1p(counts) * model.idf)
    cos = x @ model.centroids.T
    best = np.full((len(x), len(model.langs)), -1.0)
    for k in range(len(model.langs)):
        if (model.owner == k).any():
            best[:, k] = cos[:, model.owner == k].max(1)
    lang = best.argmax(1)
    e = np.exp(20 * (best - best.max(1, keepdims=True)))
    return lang, 1 / e.sum(1), best.max(1)


def verdicts(texts: pa.Array, data: np.ndarray, off: np.ndarray, model: Model) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, confidence, similarity and rejection of each text."""
    ok = np.array([has_letter(t) for t in texts.to_pylist()], bool)
    n = len(ok)
    if not model.langs:
        return ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
    counts = count_matrix(data, off)
    lang, score, sim = predict(counts, model)
    name = [model.langs[k] if g else "und" for k, g in zip(lang.tolist(), ok.tolist(), strict=True)]
    return name, np.where(ok, score, 0.0), np.clip(sim, 0, 1).astype(float), ~ok | (sim < model.floor[lang, length_class(counts)])


SCHEMA = "doc_id long, lang_pred string, score double, similarity double, rejected boolean"


def language_id(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score (0 to 1), similarity (best cosine), rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in tb.slices(b.column(1)):
                name, score, sim, rejected = verdicts(b.column(1).slice(i, j - i), data, off, model)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(sim, pa.float64()), pa.array(rejected)], ["doc_id", "lang_pred", "score", "similarity", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def without_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose language is not rejected."""
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in tb.slices(b.column(text)):
                yield b.slice(i, j - i).filter(pa.array(~verdicts(b.column(text).slice(i, j - i), data, off, model)[3]))

    return docs.mapInArrow(run, docs.schema)

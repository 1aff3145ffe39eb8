"""Jaccard graph over shared rare terms: eligible terms, pair intersections, top-K edges."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.corpus import STOP_WORDS, Similarity
from ..sources.store import written
from .index import document_frequency

#: Pairs of one term that a part counts, and those that a batch of lists makes at once.
PART, BATCH = 4_000_000, 2_000_000


def eligible_terms(index: DataFrame, settings: Similarity = Similarity(), indexed_books: int | None = None) -> DataFrame:
    """term, document_frequency of features: within the frequency bounds, long enough, no stop word."""
    n = index.select("book_id").distinct().count() if indexed_books is None else indexed_books
    term = F.col("term")
    return document_frequency(index).where(F.col("document_frequency").between(settings.min_df, settings.ceiling(n)) & (F.length(term) >= settings.min_length) & ~term.isin(*STOP_WORDS))


def feature_postings(index: DataFrame, terms: DataFrame) -> DataFrame:
    return index.select("book_id", "term").join(terms.select("term"), "term")


def feature_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("book_id").agg(F.count("*").cast("int").alias("features"))


def _lists(features: DataFrame) -> DataFrame:
    """A row for each term of two books or more: books, and n, the number of features of each, sorted by n and book.

    A term's books are at most the frequency ceiling, so its list is bounded.
    """
    sized = features.where("book_id is not null").select("term", "book_id", F.count("*").over(W.partitionBy("book_id")).cast("int").alias("n"))
    lists = sized.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("n", "book_id"))).alias("x")).where(F.size("x") > 1)
    return lists.select(F.col("x.n").alias("n"), F.col("x.book_id").alias("books"))


def _runs(min_score: float):
    """For each book of a list: those that come after it and are near enough in size, as one packed row."""

    def rows(n, books, size):
        start = np.repeat(np.cumsum(size) - size, size)
        end = start + np.repeat(size, size)
        # lists one after the other, each in the order of n: the last place with n * min_score <= own n
        high = n.astype(np.float64) * min_score
        base = float(high.max(initial=0.0) + n.max(initial=0) + 1)
        which = np.repeat(np.arange(len(size)), size) * base
        last = np.minimum(np.searchsorted(which + high, which + n, side="right"), end)
        at = np.arange(len(n)) + 1
        count = np.maximum(last - at, 0)
        keep = count > 0
        at, count = at[keep], count[keep]
        offsets = np.concatenate([[0], np.cumsum(count)])
        take = np.arange(offsets[-1]) + np.repeat(at - offsets[:-1], count)
        near, sizes = (pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((offsets * x.itemsize).astype(np.int32)), pa.py_buffer(x[take])]) for x in (books, n))
        return pa.RecordBatch.from_arrays([pa.array(books[keep]), pa.array(n[keep], pa.int32()), near, sizes], ["book_id", "n", "near", "sizes"])

    def run(batches):
        for b in batches:
            size = b.column("n").value_lengths().to_numpy()
            n, books = (b.column(c).flatten().to_numpy() for c in ("n", "books"))
            # so many lists at once that the pairs, at most these, stay within a batch
            made, first, place = np.cumsum(size.astype(np.int64) ** 2), 0, np.concatenate([[0], np.cumsum(size)])
            while first < len(size):
                last = max(first + 1, int(np.searchsorted(made, (made[first - 1] if first else 0) + BATCH, side="right")))
                lo, hi = place[first], place[last]
                out = rows(n[lo:hi], books[lo:hi], size[first:last])
                if out.num_rows:
                    yield out
                first = last

    return run


def _flat(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers in a column of packed arrays, one array after the other."""
    out = [np.empty(0, kind)]
    for c in column.chunks:
        at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        out.append(np.frombuffer(c.buffers()[2], kind, (at[-1] - at[0]) // np.dtype(kind).itemsize, at[0]))
    return np.concatenate(out)


def _counts(min_shared: int, min_score: float):
    """Of a part's rows: the pairs that share enough and reach the least score, with what both have together."""

    def run(t: pa.Table) -> pa.Table:
        a, n = t.column("book_id").to_numpy(), t.column("n").to_numpy()
        ids, first, own = np.unique(a, return_index=True, return_inverse=True)
        b, sizes = _flat(t.column("near"), np.int64), _flat(t.column("sizes"), np.int32)
        own = np.repeat(own, pc.binary_length(t.column("near")).to_numpy() // 8)
        others, at, other = np.unique(b, return_index=True, return_inverse=True)
        key = np.sort(own * len(others) + other)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        shared = np.diff(np.concatenate([starts, [len(key)]]))
        own, other = key[starts] // len(others), key[starts] % len(others)
        union = n[first][own].astype(np.int64) + sizes[at][other] - shared
        keep = (shared >= min_shared) & (shared / union >= min_score)
        own, other = ids[own[keep]], others[other[keep]]
        return pa.table({"a": np.minimum(own, other), "b": np.maximum(own, other), "shared": pa.array(shared[keep], pa.int32()), "union_size": pa.array(union[keep], pa.int32())})

    return run


def _shared(features: DataFrame, min_shared: int, min_score: float) -> DataFrame:
    """a, b (a < b), shared, union_size of the pairs of books that share enough terms and reach the least score.

    A score is at most the smaller count over the larger, so a term's list, sorted by count, is paired within that bound.
    Each book's candidates come as packed lists to the part that the book hashes to; there are as many parts as the number
    of pairs asks for, so that a part's pairs, which are sorted there, are bounded.
    """
    lists = written(_lists(features), "graph-lists")
    pairs = lists.agg(F.sum(F.size("n").cast("bigint") * (F.size("n") - 1) / 2)).first()[0] or 0
    parts = int(pairs // PART) + 1
    runs = lists.mapInArrow(_runs(min_score), "book_id bigint, n int, near binary, sizes binary")
    dealt = runs.groupBy(F.pmod(F.xxhash64("book_id"), F.lit(parts)).alias("part"))
    return dealt.applyInArrow(_counts(min_shared, min_score), "a bigint, b bigint, shared int, union_size int")


def pair_intersections(features: DataFrame, min_shared: int = 2) -> DataFrame:
    """a, b (a < b), shared."""
    return _shared(features, min_shared, 0.0).select("a", "b", "shared")


def scored_pairs(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """a, b, score, shared, union_size."""
    ca, cb = counts.select(F.col("book_id").alias("a"), F.col("features").alias("na")), counts.select(F.col("book_id").alias("b"), F.col("features").alias("nb"))
    p = pairs.join(ca, "a", "left").join(cb, "b", "left").fillna(0, ["na", "nb"])
    p = p.withColumn("union_size", (F.col("na") + F.col("nb") - F.col("shared")).cast("int")).where("union_size > 0")
    return p.select("a", "b", (F.col("shared") / F.col("union_size")).alias("score"), "shared", "union_size")


def top_edges(pairs: DataFrame, settings: Similarity = Similarity()) -> DataFrame:
    """Pairs that are among the K best of either end (ties to the larger ids), once each."""
    good = pairs.where(F.col("score") >= settings.min_score)
    ends = good.withColumn("node", F.explode(F.array("a", "b")))
    w = W.partitionBy("node").orderBy(F.desc("score"), F.desc("shared"), F.desc("a"), F.desc("b"))
    kept = ends.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= settings.neighbors)
    return kept.select("a", "b", "score", "shared", "union_size").distinct()


@dataclass
class Build:
    candidates: int
    qualifying: int
    edges: DataFrame


def qualifying_pairs(features: DataFrame, min_shared: int = 2, min_score: float = 0.0) -> DataFrame:
    """a, b, score, shared, union_size of the pairs that share enough terms and reach the least score."""
    score = F.col("shared") / F.col("union_size")
    return _shared(features, min_shared, min_score).select("a", "b", score.alias("score"), "shared", "union_size")


def _features(index: DataFrame, settings: Similarity) -> DataFrame:
    n = index.select("book_id").distinct().count()
    if n < 2:
        raise ValueError("A graph needs two indexed books at least")
    return feature_postings(index, eligible_terms(index, settings, n))


def build_graph(index: DataFrame, settings: Similarity = Similarity()) -> DataFrame:
    """The edges of the whole index; an index of less than two books is refused."""
    return top_edges(qualifying_pairs(_features(index, settings), settings.min_shared, settings.min_score), settings)


def build_stats(index: DataFrame, settings: Similarity = Similarity()) -> Build:
    """The same, with the numbers of pairs that share enough terms and of those that reach the least score."""
    pairs = written(qualifying_pairs(_features(index, settings), settings.min_shared), "graph-pairs")
    r = pairs.agg(F.count("*").alias("c"), F.count_if(F.col("score") >= settings.min_score).alias("q")).first()
    return Build(r.c, r.q, top_edges(pairs, settings))


def status(edges: DataFrame) -> DataFrame:
    """edges and connected_books."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("n")).agg(F.countDistinct("n").alias("connected_books"))
    return edges.agg(F.count("*").alias("edges")).crossJoin(ends)  # one row each


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst, score, shared, union_size for each direction."""
    rest = ["score", "shared", "union_size"]
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), *rest).unionAll(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), *rest))


def neighbors(edges: DataFrame, book_id: int, limit: int = 10) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("The limit must be from 1 to 100")
    other = F.when(F.col("a") == book_id, F.col("b")).otherwise(F.col("a"))
    return edges.where((F.col("a") == book_id) | (F.col("b") == book_id)).select(other.alias("book_id"), "score", "shared", "union_size").orderBy(F.desc("score"), "book_id").limit(limit)

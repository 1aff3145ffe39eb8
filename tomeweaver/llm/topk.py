"""Exact top-k inner products by ball trees.

Candidates are dealt into shards, and a ball tree is built once for each shard and stored.  Blocks of queries meet the
trees: every query goes down a tree best-first on its own, taking next the node of its highest upper bound among those
it has reached (q.centre + |q| * radius), and stops when that bound is below its kth score.  A block's queries take
their steps together, so that those at the same node share its arithmetic.  Shards are searched in waves, the first of
one shard and each next ``GROWTH`` times as many; a query enters a wave with the kth score that all shards before it
have given.

A vector that is null, or holds a null or non-finite component, takes no part;
nor does a row without an id.  Only vectors of one length are compared; of vectors without components all products are 0.  Rows
that repeat an id are candidates each, and none of them is a candidate of a query
of that id.  Scores are exact integers: sums that could pass 2**53 are taken in
Python integers, and scores beyond a long are held at its ends.  An empty table
gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written

#: Candidates of a shard and queries of a block; leaves hold LEAF vectors.
SHARD, BLOCK, LEAF = 16384, 4096, 256
#: Shards of a wave to those of the wave before.
GROWTH = 4
K, SCALE = 20, 64.0
#: Below every score; the id beside it stands for no row.
NEVER, NOBODY = -(2**63), 2**63 - 1


def quantised(col: Column, scale: float = SCALE) -> Column:
    return F.transform(col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))


def usable(col: Column) -> Column:
    ok = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return col.isNotNull() & F.coalesce(F.forall(col, ok), F.lit(False))


class BallTree:
    """Nodes split at the median along the direction of widest spread; a node's rows are x[start:end], in the tree's own order."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order, centre, radius, start, end, child = np.arange(len(x)), [], [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            a, b, parent = todo.pop()
            own = order[a:b]
            part = x[own]
            c = part.mean(0)
            gap = ((part - c) ** 2).sum(1)
            if parent >= 0:
                child[parent].append(len(centre))
            if b - a > leaf:
                far = part[gap.argmax()]
                other = part[((part - far) ** 2).sum(1).argmax()]
                order[a:b] = own[np.argsort(part @ (other - far), kind="stable")]
                todo += [(a, (a + b) // 2, len(centre)), ((a + b) // 2, b, len(centre))]
            centre.append(c)
            radius.append(np.sqrt(gap.max()))
            start.append(a)
            end.append(b)
            child.append([])
        self.x, self.ids = x[order], ids[order]
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.start, self.end = np.array(start), np.array(end)
        self.child = np.array([c or [-1, -1] for c in child])

    def bound(self, q: np.ndarray, norm: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Upper bounds (queries x nodes) of the products with these nodes' rows, with room for rounding."""
        b = q @ self.centre[nodes].T + norm[:, None] * self.radius[nodes]
        return b + 1e-6 * (1 + np.abs(b))


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: float64 where that is exact, else Python integers."""
    if q.shape[1] * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < 2.0**53:
        return (q @ x.T).astype(np.int64)
    big = np.array([[int(v) for v in r] for r in q], object).dot(np.array([[int(v) for v in r] for r in x], object).T)
    return np.clip(big, -(2**63), 2**63 - 1).astype(np.int64)


def search(tree: BallTree, q: np.ndarray, q_ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the scores and ids of up to ``k`` best rows of this tree that reach ``floor`` (NOBODY fills up)."""
    norm = np.sqrt((q * q).sum(1))
    best_s, best_i = np.full((len(q), k), NEVER, np.int64), np.full((len(q), k), NOBODY, np.int64)
    low = floor.astype(float).copy()
    reached = np.full((len(q), len(tree.start)), -np.inf)  # bounds of nodes that a query has reached and not taken
    reached[:, :1] = tree.bound(q, norm, np.zeros(1, int))
    going = np.arange(len(q))
    while len(going):
        node = reached[going].argmax(1)
        more = reached[going, node] >= low[going]
        going, node = going[more], node[more]
        reached[going, node] = -np.inf
        order = np.argsort(node, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(node[order])) + 1) if len(order) else ():
            at, n = going[own], int(node[own[0]])
            if tree.child[n, 0] >= 0:
                reached[at[:, None], tree.child[n]] = tree.bound(q[at], norm[at], tree.child[n])
                continue
            ids = tree.ids[tree.start[n] : tree.end[n]]
            s = exact_products(q[at], tree.x[tree.start[n] : tree.end[n]])
            same = ids[None, :] == q_ids[at][:, None]
            hit = ((s >= low[at][:, None]) & ~same).any(1)
            at, s, same = at[hit], s[hit], same[hit]
            all_s = np.concatenate([best_s[at], np.where(same, NEVER, s)], 1)
            all_i = np.concatenate([best_i[at], np.where(same, NOBODY, ids[None, :])], 1)
            top = np.lexsort((all_i, ~all_s), axis=1)[:, :k]
            best_s[at], best_i[at] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
            low[at] = np.maximum(low[at], best_s[at, k - 1])
    return best_s, best_i


def matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of lists of one length."""
    flat = pa.concat_arrays([c.flatten() for c in col.chunks]) if col.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy().astype(float).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def planted(t: pa.Table) -> pa.Table:
    """A shard's vectors as its tree, packed; integers of 32 bits where they fit."""
    order = np.argsort(t.column("vec_id").to_numpy(), kind="stable")
    tree = BallTree(matrix(t.column("v"))[order], t.column("vec_id").to_numpy()[order], LEAF)
    if np.abs(tree.x).max(initial=0) < 2**31:
        tree.x = tree.x.astype(np.int32)
    return pa.table({"dim": t.column("dim")[:1], "shard": t.column("shard")[:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})


def _searcher(k: int):
    def run(qs: pa.Table, trees: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
        if qs.num_rows:
            q, ids = matrix(qs.column("v")), qs.column("query_id").to_numpy()
            for packed in trees.column("tree"):
                tree = pickle.loads(packed.as_py())
                tree.x = tree.x.astype(float)
                s, i = search(tree, q, ids, k, qs.column("low").to_numpy())
                found = i != NOBODY
                out.append((np.repeat(ids, found.sum(1)), i[found], s[found]))
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    return run


HIT = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank (from 1), vec_id, score: each query's ``k`` best, ties to the smaller id."""
    v = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", quantised(F.col("embedding"), scale).alias("v"), is_query.alias("is_q"))
    v = v.withColumn("dim", F.size("v"))
    n = vectors.count()
    shards, blocks = -(-n // SHARD) or 1, -(-n // BLOCK // 20) or 1
    xs = v.select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"))
    trees = written(xs.groupBy("dim", "shard").applyInArrow(planted, "dim int, shard int, tree binary"), "topk-trees")
    qs = v.where("is_q").select(F.col("vec_id").alias("query_id"), "v", "dim").dropDuplicates(["query_id", "dim", "v"]).withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int"))
    qs = written(qs, "topk-queries")
    rank = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, done, wave = None, 0, 1
    while done < shards:
        last = min(shards, done + wave)
        q = qs.withColumn("low", F.lit(NEVER))
        if best is not None:
            low = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(NEVER)).alias("low"))
            q = qs.join(low, "query_id", "left").fillna({"low": NEVER})
        q = q.withColumn("shard", F.explode(F.sequence(F.lit(done), F.lit(last - 1))))
        t = trees.where(F.col("shard").between(done, last - 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        hits = q.groupBy("dim", "block", "shard").cogroup(t.groupBy("dim", "block", "shard")).applyInArrow(_searcher(k), HIT)
        hits = hits if best is None else best.unionByName(hits)
        best = written(hits.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).drop("rank"), "topk-best")
        done, wave = last, wave * GROWTH
    return best.withColumn("rank", F.row_number().over(rank)).select("query_id", "rank", "vec_id", "score")

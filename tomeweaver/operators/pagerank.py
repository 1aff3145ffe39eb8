"""Weighted, undirected PageRank whose dangling mass goes to all nodes alike."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import Ranking
from ..sources.store import dropped, written

#: So many nodes and edges one task holds in numpy; a larger graph is dealt out over tasks of that size.
SMALL = 2_000_000
#: Iterations over a graph in parts that one job makes before the driver looks at their changes.
STRIDE = 10
PARTS = "part int, ids binary, to int, send binary, pos binary, dst binary, share binary"
STATE = "part int, ids binary, score binary, deltas array<double>"


def clean_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, weight both ways: positive weights between two different known nodes."""
    e = edges.where((F.col("weight") > 0) & (F.col("a") != F.col("b")))
    e = e.join(nodes.select(F.col("book_id").alias("a")), "a", "left_semi").join(nodes.select(F.col("book_id").alias("b")), "b", "left_semi")
    return e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionAll(e.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def weighted_degree(both: DataFrame) -> DataFrame:
    return both.groupBy("src").agg(F.sum("weight").alias("degree"))


def kernel(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, damping: float, tolerance: float, limit: int) -> tuple[np.ndarray, list[float]]:
    n = len(ids)
    s, d = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    out = np.bincount(s, weights=weight, minlength=n)
    share = weight / out[s] if len(s) else weight
    r, deltas = np.full(n, 1 / n), []
    for _ in range(limit):
        new = (1 - damping + damping * r[out == 0].sum()) / n + damping * np.bincount(d, weights=r[s] * share, minlength=n)
        deltas.append(float(np.abs(new - r).sum()))
        r = new
        if deltas[-1] <= tolerance:
            break
    return r, deltas


@dataclass
class Result:
    scores: DataFrame  # book_id, score
    deltas: list[float]
    converged: bool

    @property
    def iterations(self) -> int:
        return len(self.deltas)


def pagerank(nodes: DataFrame, edges: DataFrame, settings: Ranking = Ranking(), small: int = SMALL) -> Result:
    """nodes(book_id), edges(a, b, weight)."""
    spark = nodes.sparkSession
    nodes = written(nodes.select("book_id").distinct(), "pagerank-nodes")
    both = written(clean_edges(nodes, edges), "pagerank-edges")
    n, m = nodes.count(), both.count()
    if n == 0:
        return Result(nodes.select("book_id", F.lit(0.0).alias("score")), [], True)
    d, tol, limit = settings.damping, settings.tolerance, settings.max_iterations
    if n + m <= small:
        # a checked size, so one task holds the graph
        rows = nodes.select(F.col("book_id").alias("src"), F.lit(None).cast("bigint").alias("dst"), F.lit(0.0).alias("weight")).unionAll(both)

        def run(t: pa.Table) -> pa.Table:
            src, weight = t.column("src").to_numpy(), t.column("weight").to_numpy()
            edge = t.column("dst").is_valid().to_numpy()
            ids = np.sort(src[~edge])
            dst = t.column("dst").fill_null(0).to_numpy()
            order = np.lexsort((dst[edge], src[edge]))
            r, deltas = kernel(ids, src[edge][order], dst[edge][order], weight[edge][order], d, tol, limit)
            return pa.table({"book_id": pa.array([*ids, *[None] * len(deltas)], pa.int64()), "score": pa.array([*r, *deltas]), "step": pa.array([0] * len(ids) + list(range(1, len(deltas) + 1)), pa.int32())})

        out = written(rows.groupBy(F.lit(1).alias("one")).applyInArrow(run, "book_id bigint, score double, step int"), "pagerank")
        deltas = [r.score for r in out.where("step > 0").orderBy("step").collect()]  # one number an iteration
        return Result(out.where("step = 0").select("book_id", "score"), deltas, deltas[-1] <= tol)
    return _in_parts(nodes, both, n, -(-(n + m) // small) if small > 0 else 3, settings)


def _own(part: int) -> int:
    return part


def _packed(t: pa.Table) -> pa.Table:
    """A part's nodes, and for each part that its edges lead to: the nodes whose ranks go there, and the edges by places among those."""
    part, (src, dst, to, weight) = t.column("part")[0].as_py(), (t.column(c).to_numpy() for c in ("src", "dst", "to", "weight"))
    order = np.lexsort((dst, src, to))
    src, dst, to, weight = src[order], dst[order], to[order], weight[order]
    ids, place = np.unique(src, return_inverse=True)
    share = weight / np.bincount(place, weights=weight, minlength=len(ids))[place]
    rows = [(part, ids.tobytes(), None, None, None, None, None)]
    for q in np.unique(to):
        e = to == q
        send, pos = np.unique(place[e], return_inverse=True)
        rows.append((part, None, int(q), send.astype(np.int32).tobytes(), pos.astype(np.int32).tobytes(), dst[e].tobytes(), share[e].tobytes()))
    kinds = [pa.int32(), pa.binary(), pa.int32(), *[pa.binary()] * 4]
    return pa.table({name.split()[0]: pa.array(column, kind) for name, column, kind in zip(PARTS.split(", "), zip(*rows), kinds)})


def _dealt(r):
    """What a row of PARTS says to the part that it comes from, and to the one that it leads to."""
    if r.to is None:
        return [(r.part, ("ids", np.frombuffer(r.ids, np.int64)))]
    return [(r.part, ("send", r.to, np.frombuffer(r.send, np.int32))), (r.to, ("edges", r.part, np.frombuffer(r.pos, np.int32), np.frombuffer(r.dst, np.int64), np.frombuffer(r.share)))]


def _loaded(part: int, items):
    """One item for a part: its nodes, whom it sends which ranks, and its edges by the part that they come from."""
    ids, send, edges = np.empty(0, np.int64), [], []
    for _, x in items:
        if x[0] == "ids":
            ids = x[1]
        elif x[0] == "send":
            send.append(x[1:])
        else:
            edges.append(x[1:])
    edges = [(p, pos, np.searchsorted(ids, dst), share) for p, pos, dst, share in sorted(edges, key=lambda e: e[0])]
    yield part, ("graph", ids, send, edges)


def _step(teleport: float | None, damping: float, last: bool):
    """An iteration of a part, from the ranks sent to it: its new ranks, and unless it is the last what it sends on.  Without ``teleport`` it only sends."""

    def run(items):
        ranks = {}
        for part, x in items:
            if x[0] == "graph":
                own, (_, ids, send, edges) = part, x
            elif x[0] == "state":
                old, deltas = x[1:]
            else:
                ranks[x[1]] = x[2]
        new = old
        if teleport is not None:
            new = np.full(len(ids), teleport)
            for p, pos, dst, share in edges:
                new += damping * np.bincount(dst, weights=ranks[p][pos] * share, minlength=len(ids))
            deltas = [*deltas, float(np.abs(new - old).sum())]
        if last:
            yield own, bytearray(ids.tobytes()), bytearray(new.tobytes()), deltas
        else:
            yield own, ("state", new, deltas)
            for q, s in send:
                yield q, ("ranks", own, new[s])

    return run


def _unpacked(batches):
    for b in batches:
        for ids, score in zip(b.column("ids"), b.column("score")):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids.as_buffer(), np.int64)), pa.array(np.frombuffer(score.as_buffer()))], ["book_id", "score"])


def _in_parts(nodes: DataFrame, both: DataFrame, n: int, parts: int, settings: Ranking) -> Result:
    """The iterations with the nodes dealt out over ``parts`` tasks by a hash.

    Each part keeps its edges and sends each other part only the ranks that edges lead there, so an iteration is one
    shuffle of at most a number an edge and one a node, and STRIDE iterations are one job.  Nodes without an edge all have
    the same rank, which follows from itself alone, so the driver works it out and they are dealt to no part.
    """
    spark, d, tol, limit = nodes.sparkSession, settings.damping, settings.tolerance, settings.max_iterations
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    linked = both.select("src").distinct().count()
    rows = both.select("src", "dst", "weight", part("src").alias("part"), part("dst").alias("to")).groupBy("part").applyInArrow(_packed, PARTS)
    packed = written(rows, "pagerank-parts")
    graph = packed.rdd.flatMap(_dealt).partitionBy(parts, _own).mapPartitionsWithIndex(_loaded, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
    initial = 1 / n

    def stride(state: DataFrame | None, teleports: list[float]) -> DataFrame:
        if state is None:
            x = graph.mapValues(lambda g: ("state", np.full(len(g[1]), initial), []))
        else:
            x = state.rdd.map(lambda r: (r.part, ("state", np.frombuffer(r.score), []))).partitionBy(parts, _own)
        x = graph.union(x).mapPartitions(_step(None, d, False))
        for k, c in enumerate(teleports, 1):
            x = graph.union(x.partitionBy(parts, _own)).mapPartitions(_step(c, d, k == len(teleports)))
        return written(spark.createDataFrame(x, STATE), "pagerank-state")

    state, deltas, alone, loose = None, [], 1 / n, n - linked
    while True:
        teleports, own = [], []
        for _ in range(min(STRIDE, limit - len(deltas))):
            c = (1 - d + d * loose * (teleports[-1] if teleports else alone)) / n
            own.append(loose * abs(c - (teleports[-1] if teleports else alone)))
            teleports.append(c)
        new = stride(state, teleports)
        # a row of STRIDE numbers a part
        sums = [math.fsum(x) for x in zip(own, *(r.deltas for r in new.orderBy("part").select("deltas").collect()))]
        steps = next((k for k, x in enumerate(sums, 1) if x <= tol), len(sums))
        if steps < len(sums):  # the ranks of the iteration that converged
            dropped(new)
            new = stride(state, teleports[:steps])
        if state is not None:
            dropped(state)
        state, alone = new, teleports[steps - 1]
        deltas += sums[:steps]
        if deltas[-1] <= tol or len(deltas) == limit:
            break
    graph.unpersist()
    dropped(packed)
    scores = state.select("ids", "score").mapInArrow(_unpacked, "book_id bigint, score double")
    rest = nodes.join(both.select(F.col("src").alias("book_id")), "book_id", "left_anti").select("book_id", F.lit(alone).alias("score"))
    return Result(written(scores.unionAll(rest), "pagerank"), deltas, deltas[-1] <= tol)


def top(scores: DataFrame, books: DataFrame, limit: int = 20) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("The limit must be from 1 to 100")
    return scores.join(books.select(F.col("id").alias("book_id"), "title"), "book_id").orderBy(F.desc("score"), "book_id").limit(limit)


def stats(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("nodes"), F.sum("score").alias("score_sum"), F.min("score").alias("score_min"), F.max("score").alias("score_max"))

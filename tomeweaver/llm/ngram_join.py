"""N-gram Jaccard join by count vectors in R-trees.

A document is the set of its distinct five-word shingles (64-bit hashes).
Hashes fall into groups, and the point of a document is the vector of its group
counts.  For two documents the sum of coordinate minima bounds the overlap from
above; an R-tree over the points (bulk-loaded by size, nodes hold coordinate
maxima and the least size) finds the pairs that the bound lets through, and
only those are verified on the sets.

Which points meet in one tree: 100 * overlap >= 80 * union leaves at most
(a + b) / 9 hashes that only one of two linked documents has.  In a size class
the groups are more than that, so linked documents agree wholly on one group
that is not empty: each document is dealt out by (class, group, content of the
group) and meets every document it can link with, however common its passages
are.  A document with too many empty groups for this argument also goes to a
place for such documents of its class.  Nothing is sampled or capped.

Equal sets are one node.  Within a tree, nodes known to be connected are not
compared again, and edges go out as stars (node, root).  Places with more than
``HOT`` nodes are joined without a bound.  What so hangs together is verified,
a large component in blocks of about ``BLOCK`` shingles: first each block with
shared pivots, then all nodes outside the largest part against every block.

Nulls: null text is empty, has no shingles and links with nothing; null doc_id
stays null (a component of null ids only has a null id).  Fewer than five words
are one shingle.  Rows that repeat an id are rows of their own.  Other columns
are not read.  Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textbatch as tb
from .store import dropped, shuffle_partitions, written

U = np.uint64
WORDS = 5
#: Fixed multipliers of a shingle's words.
MULTIPLIERS = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
RATIO, HOT, BLOCK, PIVOTS, FAN = 1.5, 4096, 2_000_000, 4, 32
KEY_BYTES = 6
#: Shingles (about) whose keys one task holds, with some 40 bytes for each key, and there is half a key for a shingle.
PART = 3_000_000


def needed(a, b):
    """9 * overlap must reach this for 100 * overlap >= 80 * union."""
    return 4 * (a + b)


def shingle_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, first = tb.words(data, off)
    n = len(h)
    if n >= WORDS:
        s = np.zeros(n - WORDS + 1, U)
        for k in range(WORDS):
            s += h[k : n - WORDS + 1 + k] * MULTIPLIERS[k]
        s = tb.mix(s)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            x = np.sort(s[a : b - WORDS + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            x = np.full(1, b - a, U)
            for k in range(b - a):
                x = x * U(31) + h[a + k : a + k + 1] * MULTIPLIERS[k]
            out.append(tb.mix(x))
        else:
            out.append(np.zeros(0, U))
    return out


def set_id(x: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(tb.mix(tb.mix(x).sum(keepdims=True) + U(len(x))).view(np.int64)[0])


def class_edges(upto: int) -> list[int]:
    edges = [1]
    while edges[-1] <= upto:
        edges.append(max(edges[-1] + 1, int(edges[-1] * RATIO)))
    return edges


EDGES = class_edges(1 << 40)


def groups_of(k: int) -> int:
    """Groups of size class k: sizes from EDGES[k] to EDGES[k + 1] - 1."""
    d = 2 * (EDGES[k + 1] - 1) // 9
    return 1 if d == 0 else d * 11 // 10 + 3


def places(x: np.ndarray) -> np.ndarray:
    """Keys of the places where a set meets those that it may link with."""
    n = len(x)
    k = int(np.searchsorted(EDGES, n, "right")) - 1
    out, mixed = [], tb.mix(x)
    for c in (k, k + 1) if 5 * n >= 4 * EDGES[k + 1] else (k,):
        m = groups_of(c)
        g = ((x >> U(32)) * U(m)) >> U(32)
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        keys = np.add.reduceat(mixed, start) + g[start] * MULTIPLIERS[1] + np.full(1, c + 1, U) * MULTIPLIERS[2]
        largest = min(5 * n // 4, EDGES[c + 1] - 1)
        if len(start) <= (n + largest) // 9:
            keys = np.append(keys, np.full(1, c + 1, U) * MULTIPLIERS[3])
        out.append(keys)
    return tb.mix(np.concatenate(out))


def vector(x: np.ndarray) -> np.ndarray:
    """Counts by group, of a power of two groups that grows with the set."""
    bits = max(len(x) // 8, 16).bit_length()
    return np.bincount((x >> U(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint16)


def points(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors with as many groups each: the finer ones are folded."""
    g = min(len(v) for v in vectors)
    return np.array([v if len(v) == g else v.reshape(g, -1).sum(1) for v in vectors], np.int32)


class RTree:
    """Points in order of size; each level's nodes hold FAN of the level below."""

    def __init__(self, p: np.ndarray, n: np.ndarray):
        self.order = np.lexsort((p[:, 0], n))
        self.levels = [(p[self.order], n[self.order])]
        while len(self.levels[-1][1]) > FAN:
            v, s = self.levels[-1]
            at = np.arange(0, len(s), FAN)
            self.levels.append((np.maximum.reduceat(v, at), np.minimum.reduceat(s, at)))

    def search(self, v: np.ndarray, n: int) -> np.ndarray:
        """Points whose bound with this one suffices."""
        at = np.arange(len(self.levels[-1][1]))
        for level in range(len(self.levels) - 1, -1, -1):
            p, s = self.levels[level]
            at = at[9 * np.minimum(p[at], v).sum(1) >= needed(s[at], n)]
            if level:
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < len(self.levels[level - 1][1])]
        return self.order[at]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def components(vectors: list[np.ndarray], n: np.ndarray, sets: list[np.ndarray] | None = None) -> np.ndarray:
    """A label (the least index) for each point: joined where the bound, and the sets if given, link.

    Each point outside the largest component is compared with all, so pairs
    inside it are the only ones left out.
    """
    label = np.arange(len(n))
    if len(n) == 1:
        return label
    p = points(vectors)
    tree = RTree(p, n)
    todo = np.ones(len(n), bool)
    size = np.ones(len(n), int)
    giant = 0
    while True:
        left = np.flatnonzero(todo & (label != giant)) if size[giant] > 1 else np.flatnonzero(todo)
        if not len(left):
            return label
        i = int(left[0])
        todo[i] = False
        for j in tree.search(p[i], int(n[i])).tolist():
            if label[j] != label[i] and (sets is None or 9 * overlap(sets[i], sets[j]) >= needed(int(n[i]), int(n[j]))):
                a, b = sorted((int(label[i]), int(label[j])))
                label[label == b] = a
                size[a] += size[b]
                size[b] = 0
        giant = int(size.argmax())


def _ids(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, sid and vec (null for an empty set); keyed, also a hash of the text."""
    names = ["doc_id", "n_shingles", "sid", "vec", *(["text_hash"] if keyed else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in tb.slices(b.column(1)):
                s = shingle_sets(data, off)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), pa.array([len(x) for x in s], pa.int64()), pa.array([set_id(x) if len(x) else None for x in s], pa.int64()), pa.array([vector(x).tobytes() if len(x) else None for x in s], pa.binary()), *(b.column(c).slice(i, j - i) for c in range(2, b.num_columns))], names)

    read = docs.select("doc_id", "text", *([F.xxhash64("text").alias("text_hash")] if keyed else []))
    return read.mapInArrow(run, "doc_id long, n_shingles long, sid long, vec binary" + (", text_hash long" if keyed else ""))


def _met(docs: DataFrame, parts: int) -> DataFrame:
    """gid, members: distinct groups of two or more sets that met in a place (packed, sorted sids)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def flush(keys: list[np.ndarray], ids: list[int]) -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            key = np.concatenate(keys)
            p = (key >> U(48)) * U(parts) >> U(16)
            order = np.argsort(p, kind="stable")
            key, at, cut = key[order], at[order], np.searchsorted(p[order], np.arange(parts + 1))
            low = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
            sid = np.array(ids, np.int64)
            rows = []
            for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                if cut[k] < cut[k + 1]:
                    own, counts = np.unique(at[cut[k] : cut[k + 1]], return_counts=True)
                    rows.append((k, sid[own].tobytes(), counts.astype("<u4").tobytes(), np.ascontiguousarray(low[cut[k] : cut[k + 1]]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], ["p", "sid", "n", "keys"])

        keys, ids, held = [], [], 0
        for b in batches:
            for _, _, data, off in tb.slices(b.column(0)):
                for x in shingle_sets(data, off):
                    if len(x) and (sid := set_id(x)) not in seen:
                        if len(seen) > 200_000:  # equal sets may go out again after this, and are told apart later
                            seen.clear()
                        seen.add(sid)
                        keys.append(places(x))
                        ids.append(sid)
                        held += len(keys[-1])
                if held > 750_000:
                    yield from flush(keys, ids)
                    keys, ids, held = [], [], 0
        yield from flush(keys, ids)

    def meet(t: pa.Table) -> pa.Table:
        keys, ids = [], []
        for s, n, k in zip(*(t.column(c).to_pylist() for c in ("sid", "n", "keys")), strict=True):
            ids.append(np.repeat(np.frombuffer(s, np.int64), np.frombuffer(n, "<u4")))
            raw = np.zeros((len(k) // KEY_BYTES, 8), np.uint8)
            raw[:, :KEY_BYTES] = np.frombuffer(k, np.uint8).reshape(-1, KEY_BYTES)
            keys.append(raw.view("<u8").ravel())
        key, sid = np.concatenate(keys), np.concatenate(ids)
        del keys, ids
        # only keys that occur again are of interest
        order = np.argsort(key, kind="stable")
        key, sid = key[order], sid[order]
        del order
        same = key[1:] == key[:-1]
        keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        key, sid = key[keep], sid[keep]
        order = np.lexsort((sid, key))
        key, sid = key[order], sid[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        key, sid = key[first], sid[first]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        size = np.diff(np.append(start, len(key)))
        found: dict[int, tuple[bytes, int]] = {}
        if len(start):
            name = np.add.reduceat(tb.mix(sid.view(U)), start) + size.astype(U)
            name = tb.mix(name).view(np.int64)
            wanted = np.flatnonzero(size > 1)
            _, at = np.unique(name[wanted], return_index=True)
            for k in wanted[at].tolist():
                found[int(name[k])] = (sid[start[k] : start[k] + size[k]].tobytes(), int(size[k]))
        return pa.table({"gid": pa.array(list(found), pa.int64()), "members": pa.array([x[0] for x in found.values()], pa.binary()), "size": pa.array([x[1] for x in found.values()], pa.int64())})

    blocks = docs.select("text").mapInArrow(scan, "p int, sid binary, n binary, keys binary")
    return blocks.groupBy("p").applyInArrow(meet, "gid long, members binary, size long").dropDuplicates(["gid"])


def _unpacked(met: DataFrame) -> DataFrame:
    """gid, size, sid"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, m, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                x = np.frombuffer(m, np.int64)
                for a in range(0, len(x), 1 << 16):
                    part = x[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), g, np.int64)), pa.array(np.full(len(part), n, np.int64)), pa.array(part)], ["gid", "size", "sid"])

    return met.select("gid", "members", "size").mapInArrow(run, "gid long, size long, sid long")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes(node, doc_id, ...) with n and hashes (packed), from the text of that document."""
    extra = [c for c in nodes.columns if c not in ("node", "doc_id")]
    kinds = dict(nodes.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sids = b.column(1).to_pylist()
            for i, j, data, off in tb.slices(b.column(0)):
                # another row may have the same id
                s = [(k, x) for k, x in enumerate(shingle_sets(data, off), i) if len(x) and set_id(x) == sids[k]]
                own = b.take(pa.array([k for k, _ in s], pa.int64())).columns[1:]
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(x) for _, x in s], pa.int64()), pa.array([x.tobytes() for _, x in s], pa.binary())], ["node", *extra, "n", "hashes"])

    w = nodes.withColumnRenamed("doc_id", "w_id")
    d = docs.select("doc_id", "text").join(w, F.col("doc_id").eqNullSafe(F.col("w_id"))).select("text", "node", *extra)
    return d.mapInArrow(run, ", ".join(["node long", *(f"{c} {kinds[c]}" for c in extra), "n long", "hashes binary"]))


def _stars(sid: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, int]]:
    least = np.full(len(label), np.iinfo(np.int64).max)
    np.minimum.at(least, label, sid)
    root = least[label]
    yield from ((int(a), int(b)) for a, b in zip(sid, root, strict=True) if a != b)


def _edges(pairs: set[tuple[int, int]]) -> pa.Table:
    rows = sorted(pairs)
    return pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())})


def _runs(keys: np.ndarray) -> Iterator[np.ndarray]:
    order = np.argsort(keys, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(keys[order])) + 1)


def _candidates(members: DataFrame, named: DataFrame, parts: int) -> DataFrame:
    """Edges (a, b) of nodes that met and whose bound suffices; all of a place that is hot."""

    def run(t: pa.Table) -> pa.Table:
        gid, sid, n = (t.column(c).to_numpy() for c in ("gid", "sid", "n"))
        vec = t.column("vec").to_pylist()
        pairs: set[tuple[int, int]] = set()
        for own in _runs(gid):
            pairs.update(_stars(sid[own], components([np.frombuffer(vec[k], np.uint16) for k in own.tolist()], n[own])))
        return _edges(pairs)

    deal = F.pmod(F.xxhash64("gid"), F.lit(parts)).cast("int")
    mild = members.where(F.col("size") <= HOT).join(named.select("sid", "n", "vec"), "sid").withColumn("q", deal)
    found = mild.groupBy("q").applyInArrow(run, "a long, b long")
    hot = members.where(F.col("size") > HOT)
    least = hot.groupBy("gid").agg(F.min("sid").alias("b"))
    return found.unionAll(hot.join(least, "gid").where("sid <> b").select(F.col("sid").alias("a"), "b")).distinct()


def connected(edges: DataFrame, label: str) -> DataFrame:
    """node, root (the least node of its component) for every node of edges(a, b): alternating large and small stars."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = None
    while True:
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        m = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(m, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).unionAll(m.select("a", F.col("m").alias("b")))
        last, e = e, written(small.where("a <> b").distinct(), label)
        dropped(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


def _verified(docs: DataFrame, nodes: DataFrame, parts: int) -> DataFrame:
    """Edges (a, b) of verified links, as stars; nodes(node, root, n, doc_id) are the components of candidates."""
    size = nodes.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    nodes = nodes.drop("n").join(size, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    nodes = written(nodes, "ngram-nodes")
    deal = lambda *c: F.pmod(F.xxhash64(*c), F.lit(parts)).cast("int")

    def hashes_of(t: pa.Table) -> list[np.ndarray]:
        return [np.frombuffer(x.as_buffer(), U) for c in t.column("hashes").chunks for x in c]

    def in_block(t: pa.Table) -> pa.Table:
        pairs: set[tuple[int, int]] = set()
        unit, sid, n = (t.column(c).to_numpy() for c in ("unit", "node", "n"))
        hashes = hashes_of(t)
        for own in _runs(unit):
            if len(own) > 1:
                sets = [hashes[i] for i in own.tolist()]
                pairs.update(_stars(sid[own], components([vector(x) for x in sets], n[own], sets)))
        return _edges(pairs)

    big = nodes.where("blocks > 1")
    pivots = big.withColumn("r_", F.row_number().over(W.partitionBy("root").orderBy(F.xxhash64("node", F.lit(2)), "node"))).where(F.col("r_") <= PIVOTS)
    # a pivot goes to every block, and is made from its text once
    spread = nodes.join(pivots.select("node", F.lit(True).alias("pivot")), "node", "left")
    sets = _sets(docs, spread.select("node", "doc_id", "root", "block", "blocks", F.coalesce("pivot", F.lit(False)).alias("pivot")))
    to = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    units = sets.withColumn("block", F.explode(to)).withColumn("unit", F.xxhash64("root", "block")).withColumn("q", deal("root", "block"))
    first = written(units.select("q", "unit", "node", "n", "hashes").groupBy("q").applyInArrow(in_block, "a long, b long"), "ngram-links")
    if big.limit(1).count() == 0:
        return first
    # nodes outside the largest part of a big component meet every block of it
    so_far = connected(first, "ngram-part")
    part = big.join(so_far.select("node", F.col("root").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))
    sizes = part.groupBy("root", "part").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("root").agg(F.max(F.struct("c", "part")).alias("x")).select("root", F.col("x.part").alias("largest"))
    part = part.join(largest, "root").withColumn("asks", F.col("part") != F.col("largest"))
    part = written(part, "ngram-parts")
    rest = part.where("asks")
    if rest.limit(1).count() == 0:
        return first
    # as many chunks as the rest has blocks' worth of nodes
    chunks = part.groupBy("root").agg(F.ceil(F.count_if("asks") * F.first("blocks") / F.count("*")).cast("int").alias("chunks")).where("chunks > 0")
    part = part.join(chunks, "root").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks")).cast("int"))
    sets = _sets(docs, part.select("node", "doc_id", "root", "part", "asks", "block", "blocks", "chunk", "chunks"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asking = sets.where("asks").withColumn("block", F.explode(every("blocks")))
    asked = sets.withColumn("asks", F.lit(False)).withColumn("chunk", F.explode(every("chunks")))
    met = asking.unionByName(asked).withColumn("unit", F.xxhash64("root", "chunk", "block")).withColumn("q", deal("root", "chunk", "block"))

    def across(t: pa.Table) -> pa.Table:
        pairs: set[tuple[int, int]] = set()
        unit, sid, n, part_, asks = (t.column(c).to_numpy() for c in ("unit", "node", "n", "part", "asks"))
        hashes = hashes_of(t)
        for own in _runs(unit):
            x, y = own[asks[own]], own[~asks[own]]
            if not len(x) or not len(y):
                continue
            p = points([vector(hashes[k]) for k in [*x.tolist(), *y.tolist()]])
            tree = RTree(p[len(x) :], n[y])
            joined: set[tuple[int, int]] = set()
            for i, k in enumerate(x.tolist()):
                for j in tree.search(p[i], int(n[k])).tolist():
                    o = int(y[j])
                    if part_[o] != part_[k] and (int(part_[k]), int(part_[o])) not in joined and 9 * overlap(hashes[k], hashes[o]) >= needed(int(n[k]), int(n[o])):
                        joined.add((int(part_[k]), int(part_[o])))
                        pairs.add((int(sid[k]), int(sid[o])))
        return _edges(pairs)

    second = met.select("q", "unit", "node", "part", "asks", "n", "hashes").groupBy("q").applyInArrow(across, "a long, b long")
    return first.unionAll(second)


def _labelled(docs: DataFrame, parts: int | None = None, keyed: bool = False) -> DataFrame:
    """The rows of ``_ids`` without vec, with label: the component, null for an empty set."""
    rows = written(_ids(docs, keyed), "ngram-ids")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    parts = parts or max(shuffle_partitions(docs.sparkSession), -(-total // PART))
    met = written(_met(docs, parts), "ngram-met")
    members = _unpacked(met)
    named = rows.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("vec").alias("vec"))
    roots = connected(_candidates(members, named, parts), "ngram-candidates")
    nodes = roots.join(named.select(F.col("sid").alias("node"), "doc_id", "n"), "node")
    labels = connected(_verified(docs, nodes, parts), "ngram-components")
    return written(rows.drop("vec").join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("root", "sid")), "ngram-labels")


def ngram_components(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id: the least doc_id that links reach."""
    r = _labelled(docs, parts)
    # both are tables, so that the join of a hot component's rows can be split
    least = written(r.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("least")), "ngram-least")
    out = r.join(least, "label", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: of the rows with its least doc_id (null last) one of the least text hash.

    Rows without shingles are in no component and all stay.
    """
    r = _labelled(docs, keyed=True)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    # the count goes by key, so that rows that agree in id and text, of which one stays, are told from the others
    of = r.where(F.col("label").isNotNull()).groupBy("label", "doc_id", "text_hash").agg(F.count("*").alias("rows_"))
    first = of.groupBy("label").agg(F.min(F.struct(key.alias("key"), "rows_")).alias("x")).select("x.key.doc_id", "x.key.text_hash", (F.col("x.rows_") > 1).alias("many_"))
    bare = r.where(F.col("label").isNull()).select("doc_id", "text_hash", F.lit(False).alias("many_")).distinct()
    keep = written(first.unionByName(bare), "ngram-keep").select(F.col("doc_id").alias("keep_id"), F.col("text_hash").alias("keep_hash"), "many_")
    on = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.xxhash64("text") == F.col("keep_hash"))
    once = docs.join(keep.where(~F.col("many_")), on, "left_semi")
    # no shuffle of these texts but one a key and task
    copies = docs.select("doc_id", F.xxhash64("text").alias("hash_"), F.struct(*docs.columns).alias("row_")).join(keep.where("many_"), F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("hash_") == F.col("keep_hash")), "left_semi")
    return once.unionByName(copies.groupBy("doc_id", "hash_").agg(F.first("row_").alias("row_")).select("row_.*"))

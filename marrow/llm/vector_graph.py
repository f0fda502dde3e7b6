"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors are dealt to clusters (k-means in two levels on a bounded sample, CLUSTER vectors each on average).  Each is
in its nearest cluster's shard and, as an overlap, in the next one's; a robust-pruned proximity graph is built in
every shard, and a vector's adjacency lists of its shards are united into one flat graph.  Neighbouring shards lie in
one region of up to REGION vectors, and searches run in regions, across their shards: greedily from the medoids of
all shards (and from the vector itself where it is there), and, once inside the range, on through the neighbours of
all that is found there.  A vector searches the regions of the clusters whose centroid is not much farther than its
nearest, and that of its second nearest.  Cosines are computed in single precision and again in double precision wherever the error could matter.

The result is audited: the links of a bounded random sample of vectors are counted by brute force against all vectors.
A vector's recall is the share of its linked vectors that the search found, however many copies they have, and each
vector with a link counts once in the mean of those with about as many links.  Where the least of these means is under
RECALL the search is repeated with a wider margin, and at last without the graph: all clusters within the bound that
loses none (twice the range's angle beyond the nearest), compared whole, in blocks.  That pass is exact.

A link is counted in one region alone, so links are counted without a list of pairs: in the searcher's own if the
other vector is there too, by overlap or not, else in that of the other's nearest cluster if it is searched, and else
in that of its second.  The regions send the edges of a spanning forest, from which components are made.  A cluster of more than SHARD vectors, its overlap
included, is split at random into shards of that size, and the searchers of a region are dealt over tasks in blocks
of QUERIES, so no task holds more than these however many near copies there are.  Equal vectors stand for one another.

Defined results: a vector that is null, empty, zero, or holds a null or a number that is not finite links with
nothing, and so do two vectors of different lengths.  Null ids are ignored as neighbours and get no component.  Each
row counts as a vector; rows that repeat an id have their own links and share a component.  An empty table gives
an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from marrow.llm.common import saved
from marrow.llm.groups import components, look_up

CLUSTER, SHARD, REGION, QUERIES = 1000, 4000, 24_000, 12_000
#: The centroids are kept by the driver and by each task; each is learned from so many sampled vectors.  Beyond
#: CLUSTER * MAX_CLUSTERS vectors clusters grow instead.
MAX_CLUSTERS, PER_CLUSTER = 65_536, 10
DEGREE, WIDE, POOL, FAR, ALPHA, BEAM = 12, 24, 24, 6, 1.2, 16
#: The clusters searched are those whose centroid's angle is at most so much (radians) above the nearest one's.
MARGINS = (math.radians(3), math.radians(12))
#: A random sample of so many vectors is audited; groups with fewer of them than ENOUGH are taken together.
RECALL, AUDITED, ENOUGH = 0.95, 2000, 20


def _rows(column: pa.Array) -> np.ndarray:
    """A list column, whose lists are equally long, as a matrix of unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    x /= np.abs(x).max(1, keepdims=True)  # else squares of tiny or huge numbers vanish or overflow
    return x / np.sqrt(np.einsum("id,id->i", x, x))[:, None]


def _by_length(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch in parts whose vectors (in column ``at``) are equally long, with these as unit vectors."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            part = batch if (sizes == d).all() else batch.take(pa.array(np.flatnonzero(sizes == d)))
            for k in range(0, len(part), 4000):
                piece = part.slice(k, 4000)
                yield piece, _rows(piece.column(at))


def _alike(q: np.ndarray, x: np.ndarray, c: np.ndarray, cosine: float, qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
    """Whether the cosines of pairs (qi, vi) reach ``cosine`` in double precision, from those in single precision."""
    out = c >= cosine
    unsure = np.flatnonzero(np.abs(c - cosine) <= (q.shape[1] + 8) * 2.0**-22)
    out[unsure] = np.einsum("id,id->i", q[qi[unsure]], x[vi[unsure]]) >= cosine
    return out


def prune(x: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Robust pruning of each row's candidates (indices; -1: none): the nearest stays and removes those that it is
    ALPHA times closer to than the row is.  Rows of DEGREE indices, padded with -1."""
    n, c = pool.shape
    out = np.full((n, DEGREE), -1)
    for at in range(0, n, 512):
        p = pool[at : at + 512]
        lines = np.arange(len(p))
        order = np.argsort(p, axis=1)
        p = np.take_along_axis(p, order, 1)
        alive = (p >= 0) & (p != at + lines[:, None])
        alive[:, 1:] &= p[:, 1:] != p[:, :-1]
        vectors = x[np.maximum(p, 0)]
        near = np.matmul(vectors, x[at : at + len(p), :, None])[:, :, 0]
        between = np.matmul(vectors, vectors.transpose(0, 2, 1))
        far = 2 - 2 * near
        for k in range(DEGREE):
            first = np.where(alive, near, -np.inf).argmax(1)
            some = alive[lines, first]
            if not some.any():
                break
            out[at + lines[some], k] = p[lines, first][some]
            alive &= ALPHA**2 * (2 - 2 * between[lines, first]) > far
            alive[lines, first] = False
    return out


def build(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of a shard's vectors (in single precision): for each up to DEGREE that robust pruning leaves,
    nearest first, then all reversed ones, so what is pruned for a nearer hub is found from that hub."""
    n = len(x)
    if n == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = min(POOL, n - 1)
    pool = np.empty((n, k + FAR), np.int64)
    for at in range(0, n, 512):
        near = x[at : at + 512] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        pool[at : at + 512, :k] = np.argpartition(near, n - k, axis=1)[:, n - k :]
    pool[:, k:] = rng.integers(0, n, (n, FAR))
    out = prune(x, pool)
    a, slot = np.nonzero(out >= 0)
    b = out[a, slot]
    order = np.lexsort((np.r_[slot, slot + DEGREE], np.r_[a, b]))
    return np.r_[a, b][order], np.r_[b, a][order]


class Graph:
    """Adjacency lists one after the other, and the first WIDE of each as a matrix (-1: none)."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray):
        """Edges (a, b), those of one vector in their order; repeated ones are left out."""
        kept = np.sort(np.unique(a * n + b, return_index=True)[1])
        order = kept[np.argsort(a[kept], kind="stable")]
        a, self.to = a[order], b[order]
        self.start = np.searchsorted(a, np.arange(n + 1))
        rank = np.arange(len(a)) - self.start[a]
        some = rank < WIDE
        self.first = np.full((n, WIDE), -1)
        self.first[a[some], rank[some]] = self.to[some]

    def neighbours(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours of all of v, and for each the place in v that it comes from."""
        size = self.start[v + 1] - self.start[v]
        place = np.repeat(np.arange(len(v)), size)
        return self.to[np.repeat(self.start[v] - (np.cumsum(size) - size), size) + np.arange(len(place))], place

    def reached(self, starts: np.ndarray) -> np.ndarray:
        seen = np.zeros(len(self.first), bool)
        seen[starts] = True
        front = starts
        while len(front):
            front = np.unique(self.neighbours(front)[0])
            front = front[~seen[front]]
            seen[front] = True
        return seen


def _parts(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices of consecutive items with about so much in all."""
    total = np.cumsum(sizes)
    cuts = np.unique(np.r_[0, np.searchsorted(total, np.arange(limit, int(total[-1]) + 1, limit)) + 1, len(sizes)])
    return (slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def search(q: np.ndarray, x: np.ndarray, graph: Graph, starts: np.ndarray, own: np.ndarray, cosine: float, beam: int):
    """Yields (query, vector) index arrays of verified pairs in the range; each pair once.

    q, x: unit vectors in double precision.  own: the query's own vector in the graph (-1: not there), from which it
    starts as well as from ``starts``."""
    q4, x4 = q.astype(np.float32), x.astype(np.float32)
    n, extra = len(x), WIDE
    step = max(1, min(len(q), 1000, 30_000_000 // n))
    for at in range(0, len(q), step):
        qs = q4[at : at + step]
        lines = np.arange(len(qs))
        seen = np.zeros((len(qs), n), bool)
        seen[:, starts] = True
        me = own[at : at + step]
        there = (me >= 0) & ~np.isin(me, starts)
        seen[lines[there], me[there]] = True
        hits_q, hits_v = [], []

        def found(qi, vi, c):
            keep = c >= cosine - 1e-2
            qi, vi, c = qi[keep], vi[keep], c[keep]
            keep = _alike(q[at : at + step], x, c, cosine, qi, vi)
            hits_q.append(qi[keep])
            hits_v.append(vi[keep])
            return qi[keep], vi[keep]

        # the beam: the best vectors seen, the best of the medoids and the query's own at first
        first = qs @ x4[starts].T
        found(np.repeat(lines, len(starts)), np.tile(starts, len(qs)), first.ravel())
        best = np.concatenate([np.broadcast_to(starts, first.shape), np.maximum(me, 0)[:, None]], 1)
        cos = np.concatenate([first, np.where(there, np.einsum("id,id->i", qs, x4[np.maximum(me, 0)]), -np.inf)[:, None]], 1).astype(np.float32)
        found(lines[there], me[there], cos[there, -1])
        if best.shape[1] > beam:
            top = np.argpartition(cos, -beam, axis=1)[:, -beam:]
            best, cos = np.take_along_axis(best, top, 1), np.take_along_axis(cos, top, 1)
        done = cos == -np.inf
        while True:  # greedy: expand the best that is not expanded yet
            open_cos = np.where(done, -np.inf, cos)
            pick = open_cos.argmax(1)
            go = np.flatnonzero(open_cos[lines, pick] > -np.inf)
            if not len(go):
                break
            done[go, pick[go]] = True
            vi = graph.first[best[go, pick[go]]]
            fresh = (vi >= 0) & ~seen[go[:, None], vi]
            if not fresh.any():
                continue
            row, slot = np.nonzero(fresh)
            qi, vi = go[row], vi[row, slot]
            seen[qi, vi] = True
            c = np.einsum("id,id->i", qs[qi], x4[vi])
            found(qi, vi, c)
            add_v, add_c = np.zeros((len(qs), extra), np.int64), np.full((len(qs), extra), -np.inf, np.float32)
            add_v[qi, slot], add_c[qi, slot] = vi, c
            best, cos = np.concatenate([best, add_v], 1), np.concatenate([cos, add_c], 1)
            done = np.concatenate([done, add_c == -np.inf], 1)
            if best.shape[1] > beam:
                top = np.argpartition(cos, -beam, axis=1)[:, -beam:]
                best, cos, done = (np.take_along_axis(z, top, 1) for z in (best, cos, done))
        # the range: expand all that was found inside, until nothing new is
        front_q, front_v = np.concatenate(hits_q), np.concatenate(hits_v)
        while len(front_q):
            grown_q, grown_v = [], []
            for part in _parts(graph.start[front_v + 1] - graph.start[front_v], 1_000_000):
                fq, fv = front_q[part], front_v[part]
                vi, place = graph.neighbours(fv)
                fresh = ~seen[fq[place], vi]
                code = np.unique(fq[place[fresh]] * n + vi[fresh])
                qi, vi = code // n, code % n
                seen[qi, vi] = True
                a, b = found(qi, vi, np.einsum("id,id->i", qs[qi], x4[vi]))
                grown_q.append(a)
                grown_v.append(b)
            front_q, front_v = np.concatenate(grown_q), np.concatenate(grown_v)
        yield np.concatenate(hits_q) + at, np.concatenate(hits_v)


def pairs(q: np.ndarray, x: np.ndarray, cosine: float):
    """As ``search``, but each query is compared with all vectors."""
    q4, x4 = q.astype(np.float32), x.astype(np.float32)
    for at in range(0, len(q), 500):
        c = q4[at : at + 500] @ x4.T
        qi, vi = np.nonzero(c >= cosine - 1e-2)
        keep = _alike(q[at : at + 500], x, c[qi, vi], cosine, qi, vi)
        yield qi[keep] + at, vi[keep]


class _Forest:
    """Components of a shard's nodes as pairs come in."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up
        return self.root

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            r = self.roots()
            ra, rb = r[a], r[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            if len(a):
                np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Up to k centroids of unit length, and each row's."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for last in [False] * 7 + [True]:
        own = np.concatenate([(x[at : at + 4096] @ c.T).argmax(1) for at in range(0, len(x), 4096)])
        if last:
            return c, own
        sums = np.stack([np.bincount(own, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], c).astype(np.float32)


def centroids(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """About k centroids, in two levels; those of one first-level cluster follow each other."""
    if k <= 64:
        return _kmeans(x, k, rng)[0]
    top, own = _kmeans(x, math.ceil(math.sqrt(k)), rng)
    return np.concatenate([_kmeans(x[own == t], max(1, round(k * (own == t).mean())), rng)[0] for t in range(len(top)) if (own == t).any()])


@dataclass
class Places:
    """Where vectors go: clusters by length, and the shards and regions of each cluster."""

    cents: dict[int, tuple[int, np.ndarray]]  # by length: the number of its first cluster, centroids
    parts: np.ndarray | None = None  # shards of each cluster
    region: np.ndarray | None = None  # the first region of each cluster

    def nearest(self, x: np.ndarray) -> tuple[int, np.ndarray]:
        first, c = self.cents[x.shape[1]]
        return first, x.astype(np.float32) @ c.T

    def two(self, x: np.ndarray) -> np.ndarray:
        """The nearest and second nearest cluster of each vector (the same where there is one)."""
        first, near = self.nearest(x)
        if near.shape[1] == 1:
            return np.full((len(x), 2), first)
        lines, top = np.arange(len(x)), near.argmax(1)
        near[lines, top] = -np.inf
        return np.stack([top, near.argmax(1)], 1) + first

    def settle(self, sizes: dict[int, int]) -> None:
        """Clusters of these sizes are split into shards, and shards in their order gathered to regions."""
        n = 1 + max(sizes, default=0)
        self.parts, self.region = np.ones(n, np.int64), np.zeros(n, np.int64)
        at, room = 0, REGION
        for k in range(n):
            size = sizes.get(k, 0)
            self.parts[k] = max(1, math.ceil(size / SHARD))
            if size > room:
                at, room = at + (room < REGION), REGION
            self.region[k] = at
            if size > REGION:
                at, room = at + math.ceil(self.parts[k] / self.shards_in_region), REGION
            else:
                room -= size

    @property
    def shards_in_region(self) -> int:
        return max(1, REGION // SHARD)

    def shard(self, cluster: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, region) of vectors in a cluster."""
        part = (key * 0x9E3779B1 >> 7) % self.parts[cluster]
        return cluster << 24 | part, self.region[cluster] + part // self.shards_in_region

    def regions(self, cluster: int) -> range:
        return range(self.region[cluster], self.region[cluster] + math.ceil(self.parts[cluster] / self.shards_in_region))


def _named(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, h1, h2) of every row: the h name its direction, and are null, as v is, if it links with nothing."""
    single = isinstance(kind := vectors.schema[vector_col].dataType, ArrayType) and isinstance(kind.elementType, FloatType)
    element = "float" if single else "double"
    like = pa.list_(pa.float32() if single else pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column(1), batch.column(0)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            bad, some = np.r_[0, np.cumsum(~np.isfinite(flat))], np.r_[0, np.cumsum(flat != 0)]
            good = (sizes > 0) & (bad[ends] == bad[ends - sizes]) & (some[ends] > some[ends - sizes]) & ids.is_valid().to_numpy(zero_copy_only=False)
            names = np.zeros((len(batch), 2), np.int64)
            for d in np.unique(sizes[good]):
                at = np.flatnonzero(good & (sizes == d))
                for j, row in zip(at, _rows(lists.take(pa.array(at))) + 0.0, strict=True):  # + 0.0: no negative zeros
                    names[j] = np.frombuffer(blake2b(row.tobytes(), digest_size=16).digest(), np.int64)
            v = pc.if_else(pa.array(good), lists, pa.scalar(None, lists.type)).cast(like)
            yield pa.RecordBatch.from_arrays([ids, v, *(pa.array(names[:, k], mask=~good) for k in (0, 1))], names=["id", "v", "h1", "h2"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{element}>").alias("v"))
    return rows.mapInArrow(run, f"id long, v array<{element}>, h1 long, h2 long")


def _places(heads: DataFrame, seed: int) -> Places:
    """Clusters in proportion to the number of vectors of each length."""
    rng, cents, at = np.random.default_rng(seed), {}, 0
    lengths = heads.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()  # a row for each length
    total = sum(r["count"] for r in lengths)
    for d, n in lengths:
        k = max(1, min(math.ceil(n / CLUSTER), MAX_CLUSTERS * n // total)) if n > SHARD else 1
        c = np.ones((1, d), np.float32)
        if k > 1:
            take = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < math.ceil((1 << 30) * min(1.0, 1.1 * PER_CLUSTER * k / n))
            rows = heads.filter(take & (F.size("v") == d)).select("v").limit(2 * PER_CLUSTER * k).toPandas()["v"]
            c = centroids(_rows(pa.array(rows.to_list())).astype(np.float32), k, rng)
        cents[d], at = (at, c), at + len(c)
    return Places(cents)


def _index(heads: DataFrame, places: Places, seed: int) -> DataFrame:
    """(region, home, other, shard, k, id, copies, v, next): each vector in its shards, with its neighbours there
    (their k), and the regions of its nearest and second nearest cluster."""
    like = heads.schema["v"].dataType.simpleString()

    def clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _by_length(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.unique(pair) for pair in places.two(x)]), pa.int64())], names=["cluster"])

    sizes = heads.select("v").mapInArrow(clusters, "cluster long").groupBy("cluster").count()
    places.settle({r["cluster"]: r["count"] for r in sizes.collect()})  # a row for each cluster

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _by_length(batches, 3):
            two, keys = places.two(x), batch.column(0).to_numpy()
            (shard, home), (next_shard, other) = (places.shard(two[:, j], keys) for j in (0, 1))
            for j, own in ((0, shard), (1, next_shard)):
                row = np.flatnonzero((j == 0) | (own != shard))
                where = (home, other)[j]
                yield pa.RecordBatch.from_arrays([*(pa.array(z[row]) for z in (where, home, other, own)), *(batch.column(c).take(pa.array(row)) for c in range(4))], names=["region", "home", "other", "shard", "k", "id", "copies", "v"])

    def graph_of(key, group):
        x = _rows(group.column("v").combine_chunks()).astype(np.float32)
        ids = group.column("k").to_numpy()
        order = np.argsort(ids)
        a, b = build(x[order], np.random.default_rng([seed, key[0].as_py()]))
        offsets = np.searchsorted(a, np.arange(len(x) + 1)).astype(np.int32)
        return group.take(pa.array(order)).append_column("next", pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[order][b])))

    columns = f"region long, home long, other long, shard long, k long, id long, copies long, v {like}"
    dealt = heads.select("k", "id", "copies", "v").mapInArrow(deal, columns)
    return saved(dealt.groupBy("shard").applyInArrow(graph_of, f"{columns}, next array<long>"), "graph")


def _searched(heads: DataFrame, index: DataFrame, places: Places, cosine: float, margin: float, exact: bool) -> tuple[DataFrame, DataFrame]:
    """(k, n, m) with the copies and the heads that each head links with, and (a, b) ids that connect what is
    linked.  exact: the clusters in the margin are searched whole instead of by the graph."""
    like = heads.schema["v"].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _by_length(batches, 2):
            first, near = places.nearest(x)
            angle = np.arccos(np.clip(near, -1, 1))
            home = places.shard(first + near.argmax(1), batch.column(0).to_numpy())[1]
            reach = angle.min(1, keepdims=True) + margin
            if near.shape[1] > 1:
                reach = np.maximum(reach, np.partition(angle, 1, axis=1)[:, 1:2])
            row, cluster = np.nonzero(angle <= reach + 1e-6)
            spans = [places.regions(c) for c in range(first, first + near.shape[1])]
            size = np.array([len(s) for s in spans])[cluster]
            region = np.array([s.start for s in spans])[cluster].repeat(size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            code = np.unique(row.repeat(size) * (1 << 32) + region)
            row, region = code >> 32, code & ((1 << 32) - 1)
            every = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32)), pa.array(region))
            yield pa.RecordBatch.from_arrays([pa.array(region), every.take(pa.array(row)), pa.array(home[row]), *(batch.column(c).take(pa.array(row)) for c in range(3))], names=["region", "every", "home", "k", "id", "v"])

    asked = heads.select("k", "id", "v").mapInArrow(ask, f"region long, every array<long>, home long, k long, id long, v {like}")
    blocks = {r["region"]: math.ceil(r["count"] / QUERIES) for r in asked.groupBy("region").count().collect()}  # a row for each region
    many = F.create_map(*[F.lit(x) for k, n in blocks.items() if n > 1 for x in (k, n)]) if any(n > 1 for n in blocks.values()) else F.create_map(F.lit(-1), F.lit(1))
    block = F.coalesce(many[F.col("region")], F.lit(1))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("k"), block).cast("int"))
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), block - 1)))

    def medoids(x: np.ndarray, shard: np.ndarray) -> np.ndarray:
        return np.array([at[int((x[at] @ x[at].mean(0)).argmax())] for s in np.unique(shard) for at in [np.flatnonzero(shard == s)]])

    def flat(members: pa.Table, keys: np.ndarray, row: np.ndarray) -> Graph:
        """The united adjacency lists of the distinct vectors."""
        nexts = members.column("next").combine_chunks()
        return Graph(len(keys), row.repeat(np.diff(nexts.offsets.to_numpy())), np.searchsorted(keys, nexts.flatten().to_numpy()))

    def find_in(region: int, members: pa.Table, askers: pa.Table, out: dict) -> None:
        keys, at, row = np.unique(members.column("k").to_numpy(), return_index=True, return_inverse=True)
        distinct = members.take(pa.array(at))
        ids, copies, home, other = (distinct.column(c).to_numpy() for c in ("id", "copies", "home", "other"))
        x = _rows(distinct.column("v").combine_chunks())
        qk, qid, qhome, q = askers.column("k").to_numpy(), askers.column("id").to_numpy(), askers.column("home").to_numpy(), _rows(askers.column("v").combine_chunks())
        if exact:
            found = pairs(q, x, cosine)
        else:
            g = flat(members, keys, row)
            first_shard = members.column("shard").to_numpy()
            starts = np.unique(medoids(x, first_shard[at]))
            while not (seen := g.reached(starts)).all():  # a part that no edge leads to gets a start of its own
                starts = np.unique(np.r_[starts, np.flatnonzero(~seen)[:1]])
            me = np.minimum(np.searchsorted(keys, qk), len(keys) - 1)
            found = search(q, x, g, starts, np.where(keys[me] == qk, me, -1), cosine, BEAM)
        nodes, place = np.unique(np.r_[keys, qk], return_inverse=True)
        names = np.zeros(len(nodes), np.int64)
        names[place] = np.r_[ids, qid]
        forest, total, heads_of = _Forest(len(nodes)), np.zeros(len(qk), np.int64), np.zeros(len(qk), np.int64)
        every = askers.column("every").combine_chunks()
        asks = np.sort(np.repeat(np.arange(len(qk)), np.diff(every.offsets.to_numpy())) << 32 | every.flatten().to_numpy())
        for qi, vi in found:
            code = qi << 32 | home[vi]
            at_home = asks[np.minimum(np.searchsorted(asks, code), len(asks) - 1)] == code
            apart = (home[vi] != qhome[qi]) & (other[vi] != qhome[qi])
            counted = ((qhome[qi] == region) | (apart & ((home[vi] == region) | ~at_home))) & (keys[vi] != qk[qi])
            qi, vi = qi[counted], vi[counted]
            total += np.bincount(qi, copies[vi], len(qk)).astype(np.int64)
            heads_of += np.bincount(qi, minlength=len(qk))
            forest.join(place[len(keys) + qi], place[vi])
        root = forest.roots()
        linked = np.flatnonzero(root != np.arange(len(nodes)))
        some = heads_of > 0
        for c, a, b in (("k", qk[some], np.full(len(linked), -1)), ("n", total[some], linked * 0), ("m", heads_of[some], linked * 0), ("a", qid[some] * 0, names[linked]), ("b", qid[some] * 0, names[root[linked]])):
            out[c] += [a, b]

    def find(key, members, askers):
        out = {c: [np.zeros(0, np.int64)] for c in ("k", "n", "m", "a", "b")}
        lengths = [pc.list_value_length(t.column("v")).to_numpy() for t in (members, askers)]
        for d in np.intersect1d(*lengths):  # of one length, or of several rare ones
            find_in(key[0].as_py(), *(t.take(pa.array(np.flatnonzero(n == d))) for t, n in zip((members, askers), lengths, strict=True)), out)
        return pa.table({c: np.concatenate(v) for c, v in out.items()})

    results = index.groupBy("region", "block").cogroup(asked.groupBy("region", "block")).applyInArrow(find, "k long, n long, m long, a long, b long")
    results = saved(results, "found")
    return results.filter("k >= 0").groupBy("k").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), results.filter("k < 0").select("a", "b")


def _audit(heads: DataFrame, counts: DataFrame, cosine: float) -> float:
    """The mean recall of those of AUDITED random vectors that have a link, by brute force; the least of the means
    by number of links (1, 2 to 3, 4 to 7 and so on), so vectors of large groups don't outweigh others."""
    n = heads.count()
    take = F.pmod(F.xxhash64(F.lit(5), "k"), F.lit(1 << 30)) < math.ceil((1 << 30) * min(1.0, AUDITED / max(n, 1)))
    asked = heads.filter(take).select("k", "v").limit(2 * AUDITED).toArrow()
    if not asked.num_rows:
        return 1.0
    keys = asked.column("k").to_numpy()
    by_length = {x.shape[1]: [] for b in asked.to_batches() for _, x in _by_length([b], 1)}
    for b in asked.to_batches():
        for part, x in _by_length([b], 1):
            by_length[x.shape[1]].append((part.column(0).to_numpy(), x))
    by_length = {d: (np.concatenate([k for k, _ in v]), np.concatenate([x for _, x in v])) for d, v in by_length.items()}

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(keys.tolist(), 0)
        for part, x in _by_length(batches, 1):
            if x.shape[1] in by_length:
                own, q = by_length[x.shape[1]]
                others = part.column(0).to_numpy()
                for qi, vi in pairs(q, x, cosine):
                    for k, c in zip(*np.unique(own[qi[own[qi] != others[vi]]], return_counts=True), strict=True):
                        total[int(k)] += int(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["k", "truth"])

    truth = heads.select("k", "v").mapInArrow(against, "k long, truth long").groupBy("k").agg(F.sum("truth").alias("truth")).filter("truth > 0")
    share = F.least("truth", F.coalesce("m", F.lit(0))) / F.col("truth")
    sums = truth.join(counts, "k", "left").groupBy(F.floor(F.log2("truth")).alias("size")).agg(F.sum(share).alias("share"), F.count("*").alias("n")).collect()
    means = [r["share"] / r["n"] for r in sums if r["n"] >= ENOUGH]
    if rest := [r for r in sums if r["n"] < ENOUGH]:
        means.append(sum(r["share"] for r in rest) / sum(r["n"] for r in rest))
    return min(means, default=1.0)


def links(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 11) -> DataFrame:
    """One row for each vector: id, n_links, component_id and audited_recall."""
    rows = saved(_named(vectors, id_col, vector_col), "vectors")
    heads = rows.filter(F.col("h1").isNotNull()).groupBy("h1", "h2").agg(F.min("id").alias("id"), F.any_value("v").alias("v"), F.count("*").alias("copies"))
    heads = saved(heads.withColumn("k", F.monotonically_increasing_id()), "heads")  # numbers that stay, since they are saved
    places = _places(heads, seed)
    index = _index(heads, places, seed)
    for margin, exact in (*((m, False) for m in MARGINS), (2 * math.acos(cosine), True)):
        counts, edges = _searched(heads, index, places, cosine, margin, exact)
        recall = _audit(heads, counts, cosine)
        if recall >= RECALL:
            break
    usable = rows.filter(F.col("h1").isNotNull())
    vector = F.struct("h1", "h2")
    again = saved(usable.groupBy("id").agg(F.min(vector).alias("lo"), F.max(vector).alias("hi")).filter("lo < hi").select("id"), "again")
    if again.limit(1).count():  # ids with several vectors connect them
        owners = usable.join(again, "id", "left_semi").join(heads.select("h1", "h2", F.col("id").alias("head")), ["h1", "h2"]).select("id", "head")
        edges = edges.union(owners.withColumnRenamed("head", "b").join(owners.groupBy("id").agg(F.min("head").alias("a")), "id").select("a", "b"))
    names = saved(components(edges), "components")
    known = heads.select("h1", "h2", "id", "k", "copies").join(counts, "k", "left").join(names, "id", "left")
    known = known.select("h1", "h2", "copies", F.struct((F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("c")).alias("found"))
    out = look_up(rows.select("id", "h1", "h2"), known, ["h1", "h2"], "found", "copies")
    return out.select(F.col("id").alias(id_col), F.coalesce("found.n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("found.c", "id").cast("long").alias("component_id"), F.lit(float(recall)).alias("audited_recall"))

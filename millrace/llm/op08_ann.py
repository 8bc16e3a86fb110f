"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Vectors are dealt into shards of about SHARD rows by a hash of id and vector. In a shard, points are inserted in batches:
a greedy beam search over the graph so far proposes neighbours, and relaxed distance pruning keeps the diverse ones (a
candidate goes when a kept neighbour is closer to it, by the factor ALPHA, than the point itself); reverse edges are
added and pruned likewise, in two passes over all points. Each graph is built once and written in the shared folder;
every block of queries then reads it. A query's beam search runs in every shard; the shards' best are scored again by
the exact inner product in double precision and merged.

For a graph, largest inner product becomes nearest distance by one added component that gives all its vectors the same
length. As that hides directions where lengths differ much, a shard has a graph for each band of lengths within the
factor BAND; vectors of one length are one band. Lengths are kept as logarithms, so no finite vector overflows. Equal
vectors are one graph node that lists all its ids. Queries meet shards in blocks of
QUERIES rows. Vectors that are null, empty or zero, or hold a null or a non-finite component, take no part; vectors of
another length than a query's are not its candidates. A repeated id counts as one more vector for other queries but is
never its own candidate; of its vectors the one with the smallest hash is the query. An empty table gives no rows. Equal
scores are ordered by id. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import one_each, stash, table
from millrace.llm.op06_neardup import valid

K = 20
EVERY = 20  # queries are the rows whose id this divides
SHARD, QUERIES = 6000, 1500
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 48, 96, 1.15
EXPAND = 4  # beam entries opened in one step
BATCH = 500
BAND = 1.25  # the longest vector of a band over its shortest, at most


class Graph:
    """Rows of `points` with equal lengths, and the out-edges of each (padded by -1)."""

    def __init__(self, points: np.ndarray, edges: np.ndarray | None = None, entry: int | None = None):
        self.points = points.astype(np.float32)
        self.edges = np.full((len(points), DEGREE), -1, dtype=np.int32) if edges is None else edges
        self.entry = int((self.points @ self.points.mean(axis=0)).argmax()) if entry is None else entry

    def search(self, queries: np.ndarray, beam: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The best nodes of each query by inner product, best first (-1 pads), with their products."""
        n, q = len(self.points), queries.astype(np.float32)
        m = len(q)
        nodes = np.full((m, beam), -1, dtype=np.int32)
        near = np.full((m, beam), -np.inf, dtype=np.float32)
        opened = np.ones((m, beam), dtype=bool)
        seen = np.zeros((m, n + 1), dtype=bool)
        seen[:, n] = True  # where padding points
        nodes[:, 0], near[:, 0], opened[:, 0] = self.entry, q @ self.points[self.entry], False
        seen[:, self.entry] = True
        live = np.arange(m)
        while len(live):
            rank = np.argsort(opened[live], axis=1, kind="stable")[:, :EXPAND]  # beams are sorted: the best unopened come first
            fresh = ~np.take_along_axis(opened[live], rank, axis=1)
            live, rank, fresh = live[fresh[:, 0]], rank[fresh[:, 0]], fresh[fresh[:, 0]]
            if not len(live):
                break
            picked = np.where(fresh, np.take_along_axis(nodes[live], rank, axis=1), -1)
            opened[live[:, None], rank] = True
            out = np.where(picked[:, :, None] >= 0, self.edges[picked], -1).reshape(len(live), -1)
            out = np.sort(out, axis=1)
            out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
            new = ~seen[live[:, None], out]
            seen[live[:, None], out] = True
            seen[:, n] = True
            dot = np.einsum("mcd,md->mc", self.points[out], q[live])
            dot[~new] = -np.inf
            every = np.concatenate([near[live], dot], axis=1)
            top = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(every, top, axis=1), axis=1, kind="stable"), axis=1)
            near[live] = np.take_along_axis(every, top, axis=1)
            nodes[live] = np.take_along_axis(np.concatenate([nodes[live], out], axis=1), top, axis=1)
            opened[live] = np.take_along_axis(np.concatenate([opened[live], ~new], axis=1), top, axis=1) | ~np.isfinite(near[live])
        nodes[~np.isfinite(near)] = -1
        return nodes, near

    def prune(self, at: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """The kept neighbours of each point of `at` among its candidates (padded by -1)."""
        candidates = np.sort(np.where(candidates == at[:, None], -1, candidates), axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        x = self.points[candidates]
        length = float(self.points[0] @ self.points[0])
        far = np.sqrt(np.maximum(2 * length - 2 * np.einsum("mcd,md->mc", x, self.points[at]), 0))
        far[candidates < 0] = np.inf
        order = np.argsort(far, axis=1, kind="stable")
        far, candidates = np.take_along_axis(far, order, axis=1), np.take_along_axis(candidates, order, axis=1)
        x = self.points[candidates]
        between = np.sqrt(np.maximum(2 * length - 2 * (x @ x.transpose(0, 2, 1)), 0))
        alive = np.isfinite(far)
        kept = np.full((len(at), DEGREE), -1, dtype=np.int32)
        rows = np.arange(len(at))
        for k in range(DEGREE):
            first = alive.argmax(axis=1)
            ok = alive[rows, first]
            if not ok.any():
                break
            kept[ok, k] = candidates[ok, first[ok]]
            alive &= ~((ALPHA * between[rows, first] <= far) & ok[:, None])
            alive[rows, first] = False
        return kept

    def build(self, seed: int = 17) -> Graph:
        n = len(self.points)
        rng = np.random.default_rng(seed)
        start = rng.permutation(n)[: max(2, min(n, DEGREE * 2))]
        self.edges[start] = self.prune(start, np.tile(start, (len(start), 1)).astype(np.int32))
        if self.entry not in start:
            self.edges[self.entry] = self.prune(np.array([self.entry]), start[None, :].astype(np.int32))[0]
        for turn in range(2):
            order, at = rng.permutation(n), 0
            while at < n:
                part = order[at : at + (min(BATCH, max(32, at)) if turn == 0 else BATCH)]
                at += len(part)
                found, _ = self.search(self.points[part], BUILD_BEAM)
                self.edges[part] = self.prune(part, np.concatenate([found, self.edges[part]], axis=1))
                self._reverse(part)
        return self

    def _reverse(self, part: np.ndarray) -> None:
        """Adds the edges back to `part` from its neighbours, pruning where a list overflows."""
        to, source = self.edges[part].ravel(), np.repeat(part, DEGREE).astype(np.int32)
        source, to = source[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        for low in range(0, len(nodes), BATCH):
            here = slice(low, low + BATCH)
            wide = int(count[here].max())
            slot = np.arange(wide)[None, :]
            index = np.minimum(first[here][:, None] + slot, len(source) - 1)
            new = np.where(slot < count[here][:, None], source[index], -1)
            self.edges[nodes[here]] = self.prune(nodes[here], np.concatenate([self.edges[nodes[here]], new], axis=1))


class Shard(NamedTuple):
    """One shard's distinct vectors, longest first, in bands of like length, each with a graph of its own.

    The ids that node j stands for are those at starts[j]:starts[j + 1]; band b has the nodes bands[b]:bands[b + 1]. Edges
    count within a band.
    """

    distinct: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    edges: np.ndarray
    bands: np.ndarray
    entries: np.ndarray


def log_lengths(x: np.ndarray) -> np.ndarray:
    """Logarithms of the vectors' lengths, without overflow."""
    scale = np.abs(x).max(axis=1)
    return np.log(scale) + 0.5 * np.log(((x / scale[:, None]) ** 2).sum(axis=1))


def _level(band: np.ndarray, longest: float) -> np.ndarray:
    """A band's vectors over its greatest length, with one component more that makes them all of length 1."""
    scale = np.abs(band).max()
    unit = band / scale * math.exp(math.log(scale) - longest)
    return np.concatenate([unit, np.sqrt(np.maximum(1 - (unit**2).sum(axis=1), 0))[:, None]], axis=1)


def build_shard(ids: np.ndarray, x: np.ndarray) -> Shard:
    distinct, where = np.unique(x, axis=0, return_inverse=True)
    length = log_lengths(distinct)
    down = np.argsort(-length, kind="stable")
    distinct, length = distinct[down], length[down]
    place = np.empty(len(down), dtype=np.int64)
    place[down] = np.arange(len(down))
    where = place[where.ravel()]
    order = np.lexsort((ids, where))
    starts = np.searchsorted(where[order], np.arange(len(distinct) + 1))
    bands = [0]
    while bands[-1] < len(distinct):
        bands.append(int(np.searchsorted(-length, math.log(BAND) - length[bands[-1]], side="right")))
    graphs = [Graph(_level(distinct[a:b], length[a])).build() for a, b in zip(bands, bands[1:])]
    return Shard(distinct, ids[order], starts, np.concatenate([g.edges for g in graphs]), np.array(bands), np.array([g.entry for g in graphs]))


def search_shard(shard: Shard, query_ids: np.ndarray, q: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, product) of each query's best in one shard, without itself.

    Bands are searched from the longest vectors to the shortest; a query leaves when its k-th product is more than any
    vector of the next band can reach.
    """
    distinct, ids, starts = shard.distinct, shard.ids, shard.starts
    flat = np.concatenate([q / np.abs(q).max(axis=1, keepdims=True), np.zeros((len(q), 1))], axis=1)
    long, best = log_lengths(q), [[] for _ in q]
    for low, high, entry in zip(shard.bands[:-1].tolist(), shard.bands[1:].tolist(), shard.entries.tolist()):
        longest = float(log_lengths(distinct[low : low + 1])[0])
        live = [i for i, b in enumerate(best) if len(b) < k or b[k - 1][0] <= 0 or math.log(b[k - 1][0]) <= long[i] + longest + 1e-9]
        if not live:
            break
        graph = Graph(_level(distinct[low:high], longest), shard.edges[low:high], entry)
        nodes = np.concatenate([graph.search(flat[live[i : i + BATCH]], SEARCH_BEAM)[0] for i in range(0, len(live), BATCH)])[:, : 2 * k]
        for i, found in zip(live, nodes):
            own, near = query_ids[i], best[i]
            hit = found[found >= 0] + low
            dot = distinct[hit] @ q[i]
            new: list[tuple[float, int]] = []
            for j in np.argsort(-dot, kind="stable").tolist():
                if len(new) > k and dot[j] < new[k][0]:
                    break
                new += [(float(dot[j]), v) for v in ids[starts[hit[j]] : starts[hit[j] + 1]][: k + 1].tolist() if v != own]
            near += new
            near.sort(key=lambda b: (-b[0], b[1]))
            del near[k:]
    out = [(own, v, d) for own, near in zip(query_ids.tolist(), best) for d, v in near]
    a, b, c = zip(*out) if out else ((), (), ())
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), np.array(c, dtype=np.float64)


_SHARD = "size int, shard long, vec_id long, query boolean, vector binary, ids binary, starts binary, edges binary, bands binary, entries binary"


def _matrix(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = group.column("vec_id").to_numpy()
    return ids, np.frombuffer(b"".join(group.column("vector").to_pylist()), dtype=np.float64).reshape(len(ids), -1)


def _build(group: pa.Table) -> pa.Table:
    s = build_shard(*_matrix(group))
    row = [group.column("size")[0].as_py(), group.column("shard")[0].as_py(), None, False, s.distinct.tobytes(), s.ids.tobytes(), s.starts.tobytes(), s.edges.tobytes(), s.bands.astype(np.int64).tobytes(), s.entries.astype(np.int64).tobytes()]
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in _SHARD.split(", ")]
    return pa.table({name: pa.array([v], kinds[kind]) for v, (name, kind) in zip(row, fields)})


def _search(k: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        shard, asked = group.filter(pc.invert(group.column("query"))).to_pylist(), group.filter(group.column("query"))
        if not shard or not asked.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        s = shard[0]
        distinct = np.frombuffer(s["vector"], np.float64).reshape(-1, s["size"])
        own = Shard(distinct, np.frombuffer(s["ids"], np.int64), np.frombuffer(s["starts"], np.int64), np.frombuffer(s["edges"], np.int32).reshape(-1, DEGREE), np.frombuffer(s["bands"], np.int64), np.frombuffer(s["entries"], np.int64))
        a, b, c = search_shard(own, *_matrix(asked), k)
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    return run


def _packed(it):
    for batch in it:
        raw = [np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.float64).tobytes() for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(raw, pa.binary())], names=["vec_id", "size", "vector"])


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries among vectors (vec_id, embedding)."""
    good = vectors.where(valid() & F.col("vec_id").isNotNull()).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.size("embedding").alias("size"))
    good = stash(good.mapInArrow(_packed, "vec_id long, size int, vector binary"), "shards")
    rows = good.count()
    shards = max(1, math.ceil(rows / SHARD))
    queries = one_each(good.where(F.col("vec_id") % every == 0), "vec_id", "vector")
    blocks = max(1, math.ceil(rows / every / QUERIES))
    points = good.select("vec_id", "size", "vector", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).alias("shard"))
    graphs = stash(points.groupBy("size", "shard").applyInArrow(_build, _SHARD), "graphs")
    graphs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.select("vec_id", "size", "vector", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("query"))
    found = graphs.unionByName(asked, allowMissingColumns=True).groupBy("size", "shard", "block").applyInArrow(_search(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))

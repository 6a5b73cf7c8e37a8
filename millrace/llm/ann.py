"""Approximate nearest neighbours on robust-pruned directed graphs.

Vectors are dealt by a hash of their row into shards of bounded size.  Each shard
builds one graph: greedy searches from the medoid propose each vector's neighbours,
and relaxed distance pruning (a candidate goes if a chosen neighbour is ``alpha``
times nearer to it than the vector is) keeps edges that point into different
directions; back edges are pruned alike.  Shards lie in groups.  A task builds the
graphs of its group and keeps them while the queries stream by, so a vector moves
once and a query once for each group, whatever the number of shards.  In every shard a
beam search finds a query's nearest, scored in double precision on the original
vectors; the best of a group's shards are merged there, those of the groups in Spark.

Searches move in step: numpy expands one node of every query at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, shuffle_width

#: Vectors of a shard, at most about; bytes of the vectors of a group, at most about unless one shard has more.
SHARD, GROUP_BYTES = 6000, 96_000_000
DEGREE, BEAM, ALPHA = 32, 64, 1.2


class Graph:
    """A graph over the rows of ``x`` (unit length, float32)."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7):
        self.x, self.beam = x, beam
        n = len(x)
        self.degree = min(degree, max(1, n - 1))
        rng = np.random.default_rng(seed)
        self.start = int(np.argmax(x @ x.mean(0))) if n else 0
        self.edges = np.full((n, self.degree), -1, np.int32)
        if n < 2:
            return
        order = rng.permutation(n)
        # points enter in growing batches; the first few see each other
        done, size = 0, min(n, 2 * self.degree)
        entered = order[:size]
        sim = x[entered] @ x[entered].T
        np.fill_diagonal(sim, -2)
        cand = np.argsort(-sim, axis=1)[:, : min(beam, size - 1)]
        self.edges[entered] = self._prune(entered, entered[cand], alpha)
        if self.start not in entered:
            near = np.argsort(-(x[entered] @ x[self.start]))[: self.degree]
            self.edges[self.start, : len(near)] = entered[near]
        done = size
        while done < n:
            batch = order[done : done + min(max(done // 2, 64), 512)]
            done += len(batch)
            ids, _ = self.search(x[batch], beam)
            ids = np.where(ids == batch[:, None], -1, ids)
            self.edges[batch] = self._prune(batch, ids, alpha)
            self._back(batch, alpha)

    def _prune(self, points: np.ndarray, cand: np.ndarray, alpha: float) -> np.ndarray:
        """At most ``degree`` of each point's candidates (-1: none), nearest first, that no chosen one covers."""
        x, r = self.x, self.degree
        c = np.where(cand < 0, 0, cand)
        d = 1 - np.einsum("bcd,bd->bc", x[c], x[points])
        d[cand < 0] = np.inf
        d[cand == points[:, None]] = np.inf
        srt = np.sort(cand, axis=1)
        if (srt[:, 1:] == srt[:, :-1]).any():  # repeated candidates count once
            o = np.argsort(cand, axis=1, kind="stable")
            again = np.zeros(cand.shape, bool)
            again[:, 1:] = np.take_along_axis(cand, o, 1)[:, 1:] == np.take_along_axis(cand, o, 1)[:, :-1]
            flat = np.zeros(cand.shape, bool)
            np.put_along_axis(flat, o, again, 1)
            d[flat] = np.inf
        between = 1 - np.matmul(x[c], x[c].transpose(0, 2, 1))
        out = np.full((len(points), r), -1, np.int32)
        left = d.copy()
        rows = np.arange(len(points))
        for i in range(r):
            best = left.argmin(1)
            ok = np.isfinite(left[rows, best])
            if not ok.any():
                break
            out[ok, i] = c[rows, best][ok]
            covered = alpha * between[rows, best] <= d
            left[covered & ok[:, None]] = np.inf
            left[rows[ok], best[ok]] = np.inf
        return out

    def _back(self, batch: np.ndarray, alpha: float) -> None:
        """Back edges from what the batch points to; nodes that get too many are pruned."""
        src = np.repeat(batch, self.degree)
        dst = self.edges[batch].ravel()
        keep = dst >= 0
        src, dst = src[keep], dst[keep]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, at, many = np.unique(dst, return_index=True, return_counts=True)
        most = int(many.max()) if len(many) else 0
        if not most:
            return
        for a in range(0, len(nodes), 2048):
            some, first, n = nodes[a : a + 2048], at[a : a + 2048], many[a : a + 2048]
            wide = int(n.max())
            new = np.full((len(some), wide), -1, np.int32)
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            new[np.repeat(np.arange(len(some)), n), place] = src[first[0] : first[0] + int(n.sum())]
            both = np.concatenate([self.edges[some], new], axis=1)
            used = (self.edges[some] >= 0).sum(1)
            fits = used + n <= self.degree
            for i in np.flatnonzero(fits):
                self.edges[some[i], used[i] : used[i] + n[i]] = new[i, : n[i]]
            over = np.flatnonzero(~fits)
            if len(over):
                self.edges[some[over]] = self._prune(some[over], both[over], alpha)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest rows that a beam search from the medoid finds for each query (-1: none), and their cosines."""
        x, b = self.x, len(q)
        ids = np.full((b, beam), -1, np.int32)
        sim = np.full((b, beam), -np.inf, np.float32)
        seen = np.zeros((b, beam), bool)
        ids[:, 0], sim[:, 0] = self.start, q @ x[self.start]
        live = np.arange(b)
        while len(live):
            todo = np.where(seen[live] | (ids[live] < 0), -np.inf, sim[live])
            best = todo.argmax(1)
            go = np.isfinite(todo[np.arange(len(live)), best])
            live, best = live[go], best[go]
            if not len(live):
                break
            seen[live, best] = True
            near = self.edges[ids[live, best]]
            s = np.einsum("brd,bd->br", x[np.where(near < 0, 0, near)], q[live])
            s[(near < 0) | (near[:, :, None] == ids[live][:, None, :]).any(2)] = -np.inf
            all_ids = np.concatenate([ids[live], near], axis=1)
            all_sim = np.concatenate([sim[live], s], axis=1)
            all_seen = np.concatenate([seen[live], np.zeros(near.shape, bool)], axis=1)
            top = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
            ids[live] = np.take_along_axis(all_ids, top, 1)
            sim[live] = np.take_along_axis(all_sim, top, 1)
            seen[live] = np.take_along_axis(all_seen, top, 1)
            ids[live] = np.where(np.isfinite(sim[live]), ids[live], -1)
        order = np.argsort(-sim, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """The place of each row among neighbours that are alike in all keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(at, np.diff(np.append(at, len(new))))


def _fold(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vectors; of each row that counts its id and its vector's number, by number and id.

    Of each vector the 2 * k least ids count, none more than k times: without any one id, the k least are among them.
    """
    x = np.ascontiguousarray(x + x.dtype.type(0))
    _, first, inverse = np.unique(x.view(f"V{x.shape[1] * x.itemsize}").ravel(), return_index=True, return_inverse=True)
    by = np.lexsort((ids, inverse))
    ids, node = ids[by], inverse[by]
    some = _runs(node, ids) < k
    ids, node = ids[some], node[some]
    some = _runs(node) < 2 * k
    return x[first], ids[some], node[some]


class _Shard:
    """Rows as they come, then the graph of their distinct vectors."""

    def __init__(self, k: int):
        self.k, self.rows, self.new, self.kept = k, [], 0, 0

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.rows.append((ids, x))
        self.new += len(ids)
        if self.new > max(20_000, self.kept):  # copies don't pile up
            x, ids, node = self._folded()
            self.rows, self.new, self.kept = [(ids, x[node])], 0, len(ids)

    def _folded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _fold(*(np.concatenate(c) for c in zip(*self.rows)), self.k)

    def build(self, degree: int, beam: int, alpha: float) -> None:
        self.x, ids, node = self._folded()
        self.rows = []
        self.least = np.full((len(self.x), 2 * self.k), -1, np.int64)
        self.fill = np.bincount(node, minlength=len(self.x))
        self.least[node, _runs(node)] = ids
        wide = self.x.astype(np.float64)
        self.norms = np.sqrt(np.einsum("ij,ij->i", wide, wide))
        self.graph = Graph((wide / self.norms[:, None]).astype(np.float32), degree, beam, alpha)

    def nearest(self, own: np.ndarray, q: np.ndarray, unit: np.ndarray, beam: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each query its number, the k nearest ids found and their cosines."""
        k, norms = self.k, np.sqrt(np.einsum("ij,ij->i", q, q))
        found, _ = self.graph.search(unit, min(beam, len(self.x)))
        for j, f in enumerate(found[:, : 4 * k]):
            f = f[f >= 0]
            s = np.einsum("ij,ij->i", self.x[f].astype(np.float64), np.broadcast_to(q[j], (len(f), q.shape[1]))) / (self.norms[f] * norms[j])
            ids, sc = self.least[f].ravel(), np.repeat(s, 2 * k)
            ok = (np.arange(2 * k) < self.fill[f][:, None]).ravel() & (ids != own[j])
            ids, sc = ids[ok], sc[ok]
            top = np.lexsort((ids, -sc))[:k]
            yield j, ids[top], sc[top]


def _serve(k: int, degree: int, beam: int, alpha: float):
    """Rows come by group, vectors (copy 0) by shard, then queries: of each query the k nearest that its group has."""
    types = (pa.int64(), pa.int32(), pa.int64(), pa.float64())

    def answer(shards: list[_Shard], own: np.ndarray, copies: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        unit = (q / np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]).astype(np.float32)
        best: list[list] = [[] for _ in own]
        for s in shards:
            for j, ids, sc in s.nearest(own, q, unit, beam):
                best[j].append((ids, sc))
        out = []
        for j, parts in enumerate(best):
            ids, sc = (np.concatenate(c) for c in zip(*parts))
            top = np.lexsort((ids, -sc))[:k]
            out.append((np.full(len(top), own[j]), np.full(len(top), copies[j]), ids[top], sc[top]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), types)], ["query_id", "copy", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, name, shards = None, None, []
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("grp", "shard")]
            ends = [*np.flatnonzero(_runs(*keys) == 0)[1:], batch.num_rows] if batch.num_rows else []
            for a, b in zip([0, *ends], ends):
                part = batch.slice(a, b - a)
                g, shard = int(keys[0][a]), int(keys[1][a])
                ids, x = part.column("vec_id").to_numpy(), _matrix(part.column("embedding"))
                if g != group:
                    group, name, shards = g, None, []
                if shard != name:
                    if shards and name != QUERIES:
                        shards[-1].build(degree, beam, alpha)
                    name = shard
                    if shard != QUERIES:
                        shards.append(_Shard(k))
                if shard != QUERIES:
                    shards[-1].add(ids, x)
                    continue
                copies = part.column("copy").to_numpy()
                for i in range(0, len(ids) if shards else 0, 256):
                    yield answer(shards, ids[i : i + 256], copies[i : i + 256], x[i : i + 256].astype(np.float64))

    return run


#: What stands for the shard of a group's queries, after all shards.
QUERIES = 2**31 - 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding): vectors that are neither null, empty nor zero and have only finite components; null ids go.  Floats stay floats, others are doubles."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    kept = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else e
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), kept.alias("embedding"))


def _sizes(vectors: DataFrame) -> dict[int, int]:
    """How many vectors have each length."""
    return {r["d"]: r["c"] for r in vectors.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("c")).collect()}


def groups(count: int, asked: int, length: int, shard: int) -> tuple[int, int]:
    """Shards, and the groups they lie in, for so many vectors and queries of a length.

    Each group gets every query: beyond 4, there are no more groups than make the queries
    as many rows as the vectors, unless memory asks for more.
    """
    shards = -(-count // shard)
    return shards, min(shards, max(-(-4 * count * length // GROUP_BYTES), count // max(asked, 1), 4))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of ``vectors`` found for each of ``queries``, its own id left out.

    Both have (vec_id, embedding).  Nearness is the cosine in double precision, ties to
    the smaller vec_id; equal vectors are one node that holds its least ids, so ties
    among copies are exact.  Vectors meet only vectors of their own length.  Null, zero
    and non-finite vectors take no part.  Repeated ids are rows of their own: queries that
    share an id have an answer each, and rows that share the query's id are left out of it.
    An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    vectors, asked = usable(vectors), usable(queries)
    if vectors.schema["embedding"].dataType != asked.schema["embedding"].dataType:
        vectors, asked = (t.withColumn("embedding", F.col("embedding").cast("array<double>")) for t in (vectors, asked))
    have, want = _sizes(vectors), _sizes(asked)
    dealt = {d: groups(have[d], want[d], d, shard) for d in have if d in want}
    if not dealt:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = F.size("embedding")
    shards, parts = (F.element_at(F.create_map(*[F.lit(x) for d, n in dealt.items() for x in (d, n[i])]), size) for i in (0, 1))
    group = lambda i: size.cast("long") * 1_000_000_000 + i
    row = F.xxhash64("vec_id", "embedding")
    placed = vectors.where(size.isin(list(dealt))).withColumn("shard", F.pmod(row, shards.cast("long")).cast("int"))
    placed = placed.select(group(F.col("shard") % parts).alias("grp"), "shard", F.lit(0).alias("copy"), "vec_id", "embedding")
    # queries that share an id are told apart by the order of their vectors' hashes
    twins = Window.partitionBy("vec_id").orderBy(F.xxhash64("embedding"))
    asked = asked.withColumn("copy", F.row_number().over(twins)).where(size.isin(list(dealt)))
    asked = asked.select(F.explode(F.sequence(group(F.lit(0)), group(parts - 1))).alias("grp"), F.lit(QUERIES).alias("shard"), "copy", "vec_id", "embedding")
    # more partitions than groups, so that few of them share one
    met = placed.union(asked).repartition(max(4 * sum(n for _, n in dealt.values()), shuffle_width(spark)), "grp").sortWithinPartitions("grp", "shard")
    found = scratch.save(met.mapInArrow(_serve(k, degree, beam, alpha), "query_id long, copy int, vec_id long, score double"))
    order = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

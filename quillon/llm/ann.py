"""Approximate nearest neighbours by a robust-pruned directed graph.

Vectors of one length are dealt out to shards by a digest. In each shard a graph is built in growing
batches: greedy searches on the graph so far propose neighbours for each new vector; relaxed distance pruning
keeps a neighbour unless a kept one is nearer to it by the factor ALPHA; edges back are added and pruned
alike; a second pass repeats this on the whole graph. A query is answered by a beam search in every shard of its length.
The searches of a batch run in step, as array operations. Distances are those of unit vectors; the
results are scored again on the original vectors, in double precision.

Every query visits every shard, so shards are as large as a task can hold: with n vectors, PER_ROOT * sqrt(n) of them a shard,
SHARD at least and SHARD_BYTES of memory at most. Queries meet a shard as a stream sorted behind its graph; no graph is copied.

Equal vectors are one node; of their ids only the smallest k + 1 can be among a query's results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, table, written
from quillon.llm.vectors import matrix, read

SHARD = 4096
PER_ROOT = 32
SHARD_BYTES = 256 << 20
DEGREE = 32
ALPHA = 1.2
BUILD_BEAM, SEARCH_BEAM = 64, 192
#: Vertices that each search of a batch opens in one step.
WIDTH = 4
#: Searches that run in step, at most, and bytes of the largest array that they need.
_BATCH = 512
_STEP_BYTES = 64 << 20


def beam_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, closeness) of the `beam` nearest vertices that each query's search met, nearest first; -1 where there are fewer.

    x: unit vectors; graph: (vertices, degree) with -1 for no edge.
    """
    n, m = len(x), len(q)
    each = np.arange(m)[:, None]
    seen = np.zeros((m, n + 1), dtype=bool)
    seen[:, n] = True
    ids = np.full((m, beam), n)
    close = np.full((m, beam), -np.inf, dtype=x.dtype)
    opened = np.ones((m, beam), dtype=bool)
    first = starts[:beam]
    ids[:, : len(first)], close[:, : len(first)], opened[:, : len(first)] = first, q @ x[first].T, False
    seen[each, first[None, :]] = True
    order = np.argsort(-close, axis=1, kind="stable")
    ids, close, opened = (np.take_along_axis(v, order, axis=1) for v in (ids, close, opened))
    live = np.arange(m)
    while len(live):
        shut = opened[live]
        pick = np.argsort(shut, axis=1, kind="stable")[:, :WIDTH]  # the nearest that aren't opened yet
        fresh = ~np.take_along_axis(shut, pick, axis=1)
        going = fresh.any(axis=1)
        live, pick, fresh = live[going], pick[going], fresh[going]
        if not len(live):
            break
        at = np.where(fresh, np.take_along_axis(ids[live], pick, axis=1), n)
        opened[live[:, None], pick] = True
        near = np.where(at[:, :, None] < n, graph[np.minimum(at, n - 1)], -1).reshape(len(live), -1)
        near = np.where(near < 0, n, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[live[:, None], near]] = n
        seen[live[:, None], near] = True
        new = np.einsum("md,mkd->mk", q[live], x[np.minimum(near, n - 1)], optimize=True)
        new[near == n] = -np.inf
        all_ids = np.concatenate([ids[live], near], axis=1)
        all_close = np.concatenate([close[live], new], axis=1)
        all_opened = np.concatenate([opened[live], near == n], axis=1)
        best = np.argpartition(-all_close, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(all_close, best, axis=1), axis=1, kind="stable"), axis=1)
        ids[live], close[live], opened[live] = (np.take_along_axis(v, best, axis=1) for v in (all_ids, all_close, all_opened))
    return np.where(ids == n, -1, ids), close


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(points, degree) kept neighbours: nearest first; each kept one drops candidates nearer to it, times alpha, than to the point."""
    n = len(x)
    c = np.where((candidates < 0) | (candidates == points[:, None]), n, candidates)
    c.sort(axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = n
    far = 2 - 2 * np.einsum("md,mkd->mk", x[points], x[np.minimum(c, n - 1)], optimize=True)
    far[c == n] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    c, far = np.take_along_axis(c, order, axis=1), np.take_along_axis(far, order, axis=1)
    vectors = x[np.minimum(c, n - 1)]
    between = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    out, kept = np.full((len(points), degree), -1, dtype=np.int64), np.zeros(len(points), dtype=np.int64)
    alive, rows = c < n, np.arange(len(points))
    for _ in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        r = rows[some]
        out[r, kept[r]] = c[r, first[r]]
        kept[r] += 1
        alive[r] &= alpha * alpha * np.maximum(between[r, first[r]], 0) > far[r]
        alive[r, first[r]] = False
    return out


def _in_step(n: int, dim: int) -> int:
    """Searches of a batch in a shard of n vectors: they mark what they have seen, and open WIDTH vertices each."""
    return max(16, min(_BATCH, _STEP_BYTES // max(1, n), _STEP_BYTES // (4 * WIDTH * DEGREE * dim)))


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(graph, starts) of unit vectors."""
    n = len(x)
    graph = np.full((n, degree), -1, dtype=np.int64)
    order = np.random.default_rng(seed).permutation(n)
    middle = int(np.argmax(x @ x.mean(axis=0))) if n else 0
    starts = np.unique(np.concatenate([[middle], order[: min(n, 16)]])).astype(np.int64)

    def insert(batch: np.ndarray, relax: float) -> None:
        met, _ = beam_search(x, graph, starts, x[batch], beam)
        graph[batch] = robust_prune(x, batch, np.concatenate([met, graph[batch]], axis=1), degree, relax)
        a, b = np.repeat(batch, degree), graph[batch].ravel()
        a, b = a[b >= 0], b[b >= 0]
        by = np.lexsort((a, b))
        a, b = a[by], b[by]
        targets, first, count = np.unique(b, return_index=True, return_counts=True)
        back = np.full((len(targets), count.max() if len(count) else 0), -1, dtype=np.int64)
        back[np.repeat(np.arange(len(targets)), count), np.arange(len(b)) - np.repeat(first, count)] = a
        step = max(1, 4_000_000 // max(1, (degree + back.shape[1]) ** 2))
        for s in range(0, len(targets), step):
            t = targets[s : s + step]
            graph[t] = robust_prune(x, t, np.concatenate([graph[t], back[s : s + step]], axis=1), degree, relax)

    step = _in_step(*x.shape)
    first = order[: min(n, 64)]
    if n:
        graph[first] = robust_prune(x, first, np.broadcast_to(first, (len(first), len(first))).copy(), degree, alpha)
    at = len(first)
    while at < n:
        size = min(step, at, n - at)
        insert(order[at : at + size], alpha)
        at += size
    for s in range(0, n, step):
        insert(order[s : s + step], alpha)
    return graph, starts


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: its vectors in the order of their digests, with the edges of each."""
    rows = rows.sort_values("same").reset_index(drop=True)
    graph, starts = build(_unit(matrix(rows["vec"].tolist())))
    start = np.zeros(len(rows), dtype=bool)
    start[starts] = True
    edges = [g[g >= 0].astype("<i4").tobytes() for g in graph]
    return pd.DataFrame({"dim": rows["dim"], "shard": rows["shard"], "place": np.arange(len(rows)), "same": rows["same"], "vec": rows["vec"], "start": start, "edges": edges})


class _Index:
    """A shard in memory: vectors, graph, and the digests by which results are told apart."""

    def __init__(self, nodes: pa.Table, k: int, beam: int):
        self.full = matrix(nodes["vec"].to_pylist())
        self.same = nodes["same"].to_pylist()
        self.starts = np.flatnonzero(nodes["start"].to_numpy())
        edges = [np.frombuffer(e, dtype="<i4") for e in nodes["edges"].to_pylist()]
        self.graph = np.full((len(edges), max(1, max(map(len, edges)))), -1, dtype=np.int64)
        for i, e in enumerate(edges):
            self.graph[i, : len(e)] = e
        self.x, self.norm = _unit(self.full), np.sqrt((self.full * self.full).sum(axis=1))
        self.k, self.beam = k, min(beam, len(edges))

    def search(self, ids: list[int], raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        step = _in_step(*self.x.shape)
        for s in range(0, len(ids), step):
            q = matrix(raw[s : s + step])
            met, _ = beam_search(self.x, self.graph, self.starts, _unit(q), self.beam)
            found = np.maximum(met, 0)
            score = np.einsum("md,mkd->mk", q, self.full[found]) / (np.sqrt((q * q).sum(axis=1))[:, None] * self.norm[found])
            score[met < 0] = -np.inf
            top = np.argsort(-score, axis=1, kind="stable")[:, : 3 * self.k + 3]
            # what is as near as the last of them stays too: ties go by id later
            last = np.take_along_axis(score, top[:, -1:], axis=1)
            r, c = np.nonzero((score >= last) & (met >= 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, dtype=np.int64)[s + r]), pa.array([self.same[i] for i in met[r, c].tolist()], pa.binary()), pa.array(score[r, c])], names=["query_id", "same", "score"])


def search(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row where queries (a condition on the key) holds.

    Every row of the query's length but its own (of its id) is a candidate; nearest first, ties to the smaller id; with fewer
    candidates all of them. Vectors of different lengths have no cosine and never meet. Vectors that are null, empty, zero or hold
    null or non-finite components take no part, nor do rows without id. Rows repeated with one id are one.
    A task holds one shard and one batch of queries. An empty table gives an empty table.
    """
    bounded_batches(vectors.sparkSession)
    asked = vectors.withColumn("_query", F.coalesce(queries, F.lit(False)))
    rows = written(read(asked, key, vector, "_query"), "vectors").where(F.col("vec").isNotNull() & F.col("id").isNotNull())
    members = rows.select("same", "id").distinct()
    members = members.withColumn("n", F.row_number().over(Window.partitionBy("same").orderBy("id"))).where(F.col("n") <= k + 1).drop("n")
    classes = written(rows.groupBy("dim", "same").agg(F.any_value("vec").alias("vec")), "classes")
    # one row for each length of vectors
    sizes = classes.groupBy("dim").agg(F.count("*").alias("_n"))
    per_shard = F.greatest(F.lit(shard), F.least(F.sqrt("_n") * PER_ROOT, F.lit(SHARD_BYTES) / (20 * F.col("dim") + 16 * DEGREE)))
    sizes = written(sizes.select("dim", F.ceil(F.col("_n") / per_shard).cast("int").alias("_shards")), "sizes")
    sharded = classes.join(sizes, "dim").select("dim", "same", "vec", F.pmod(F.xxhash64("same"), "_shards").cast("int").alias("shard"))
    graph = written(sharded.groupBy("dim", "shard").applyInPandas(_built, "dim int, shard int, place long, same binary, vec binary, start boolean, edges binary"), "graph")
    asking = rows.where("_query").select("id", "dim", "vec").dropDuplicates(["id"]).join(sizes, "dim")
    asking = asking.select("dim", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)).alias("shard"), "id", "vec")
    nodes = graph.withColumn("id", F.lit(None).cast("long"))
    both = nodes.unionByName(asking, allowMissingColumns=True).select("dim", "shard", "place", "id", "same", "vec", "start", "edges")
    both = both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", F.col("place").asc_nulls_last(), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            where = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).is_valid().to_numpy(zero_copy_only=False)], axis=1)
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                piece, here = batch.slice(begin, end - begin), tuple(where[begin, :2].tolist())
                if here != at:
                    at, held, index = here, [], None
                if not where[begin, 2]:
                    held.append(piece)
                    continue
                if index is None:
                    index, held = _Index(pa.Table.from_batches(held), k, beam), []
                yield from index.search(piece.column(3).to_pylist(), piece.column(5).to_pylist())

    met = both.mapInArrow(run, "query_id long, same binary, score double")
    near = met.join(members, "same").where("id != query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op10_nearest_neighbours": op10_nearest_neighbours}
ORACLE: dict[str, str] = {}

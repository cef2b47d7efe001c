"""Approximate nearest neighbours by inner product: a robust-pruned directed graph for each shard, searched by beam.

1. Equal vectors are one point with its ids. Of these the k + 1 smallest are enough: equal scores go to the smaller id, and
   one may be the query's own. They are told by a row number whose limit Spark applies before the shuffle.
2. Points are dealt into shards of about SHARD by a hash of the vector. For each shard a graph is built: points enter in
   batches that double, starting at the medoid; a greedy beam search from it proposes a point's neighbours; robust pruning
   takes the nearest and drops what is `ALPHA` times nearer to it than to the point, again and again, so that edges stay
   diverse; edges are added backwards too, and lists that overflow are pruned again. Points that no path reaches get an edge
   from a neighbour that one reaches. Inner products become distances by one more coordinate, which gives all points of a
   shard the norm of the longest.
3. Queries are dealt in slices and meet every shard's graph: a task holds one graph and one slice. All queries of a slice
   walk in step, so a step is a few array operations. What the beam holds in the end is scored exactly, in double precision
   on the original vectors, and each shard's k best are merged.

The work is queries times shards, so shards should be as large as a task's memory allows (about 0.4 kB a point of 64
components). Every point is in a graph, and every graph is searched for every query.

Rows equal in id and vector count once; an id with several vectors is searched and found by each, and its best score counts.
Vectors that are null, empty or zero, or that hold null or non-finite components, take no part, nor do null ids; vectors
meet those of their own length only. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineagelake.llm.common import written

#: Points of a shard; queries of a slice.
SHARD, SLICE = 8192, 4096
#: Edges of a point after pruning, and before it is pruned again; how much nearer to a kept neighbour a dropped one is.
DEGREE, SLACK, ALPHA = 32, 48, 1.2
#: Points that a search holds while building and while answering; points expanded in a step; searches in step.
BUILD_BEAM, QUERY_BEAM, WIDTH, TOGETHER = 64, 128, 4, 256

GRAPH = "dim int, shard int, points binary, edges binary, entry int, ids array<array<long>>"
GRAPH_ARROW = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("points", pa.binary()), ("edges", pa.binary()), ("entry", pa.int32()), ("ids", pa.list_(pa.list_(pa.int64())))])
FOUND = "query_id long, vec_id long, score double"
FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> np.ndarray:
    """For each query the points that the beam holds in the end, largest inner product first; -1 where there are fewer."""
    n, b = len(points), len(queries)
    seen = np.zeros(b * n, bool)
    held = np.full((b, beam), -1, np.int64)
    sims = np.full((b, beam), -np.inf, np.float32)
    expanded = np.zeros((b, beam), bool)
    held[:, 0], sims[:, 0] = entry, queries @ points[entry]
    seen[np.arange(b) * n + entry] = True
    live = np.arange(b)
    while True:
        waiting = np.where(expanded[live], -np.inf, sims[live])
        pick = np.argpartition(-waiting, min(WIDTH, beam) - 1, axis=1)[:, :WIDTH]
        fits = np.take_along_axis(waiting, pick, 1) > -np.inf
        keep = fits.any(1)
        live, pick, fits = live[keep], pick[keep], fits[keep]
        if not len(live):
            return held
        r, c = np.nonzero(fits)
        q, at = live[r], pick[r, c]
        expanded[q, at] = True
        out = edges[held[q, at]]
        flat = np.unique((q[:, None] * n + out)[out >= 0])
        flat = flat[~seen[flat]]
        seen[flat] = True
        q, p = np.divmod(flat, n)
        near = np.einsum("kd,kd->k", points[p], queries[q])
        count = np.bincount(q, minlength=b)[live]
        most = count.max(initial=0)
        row = np.searchsorted(live, q)
        place = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
        more, more_sims = np.full((len(live), most), -1, np.int64), np.full((len(live), most), -np.inf, np.float32)
        more[row, place], more_sims[row, place] = p, near
        both = np.concatenate([sims[live], more_sims], 1)
        order = np.argsort(-both, axis=1, kind="stable")[:, :beam]
        sims[live] = np.take_along_axis(both, order, 1)
        held[live] = np.take_along_axis(np.concatenate([held[live], more], 1), order, 1)
        expanded[live] = np.take_along_axis(np.concatenate([expanded[live], np.zeros_like(more, bool)], 1), order, 1)


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each point of own up to `degree` of its candidates (-1: none), diverse ones. All points have one norm."""
    cand = points[np.maximum(candidates, 0)]
    norm = float(points[0] @ points[0])
    to_own = np.where(candidates >= 0, np.maximum(2 * norm - 2 * np.einsum("bcd,bd->bc", cand, points[own]), 0), np.inf)
    to_own[candidates == own[:, None]] = np.inf
    order = np.argsort(to_own, axis=1, kind="stable")
    to_own, candidates = np.take_along_axis(to_own, order, 1), np.take_along_axis(candidates, order, 1)
    cand = np.take_along_axis(cand, order[:, :, None], 1)
    between = np.maximum(2 * norm - 2 * (cand @ cand.transpose(0, 2, 1)), 0)
    alive, rows = to_own < np.inf, np.arange(len(own))
    out = np.full((len(own), degree), -1, np.int64)
    for i in range(degree):
        best = alive.argmax(1)
        has = alive[rows, best]
        if not has.any():
            break
        out[has, i] = candidates[rows, best][has]
        alive &= (alpha * alpha * between[rows, best] > to_own) | ~has[:, None]
        alive[rows[has], best[has]] = False
    return out


def _add_backwards(points: np.ndarray, edges: np.ndarray, sources: np.ndarray, chosen: np.ndarray) -> None:
    r, c = np.nonzero(chosen >= 0)
    target, source = chosen[r, c], sources[r]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    touched, count = np.unique(target, return_counts=True)
    place = np.arange(len(target)) - np.repeat(np.cumsum(count) - count, count)
    size = (edges[touched] >= 0).sum(1)
    total = size + count
    row = np.repeat(np.arange(len(touched)), count)
    fits = total[row] <= edges.shape[1]
    edges[target[fits], (size[row] + place)[fits]] = source[fits]
    full = np.flatnonzero(total > edges.shape[1])
    full = full[np.argsort(total[full], kind="stable")]  # lists of like length are pruned together
    for at in range(0, len(full), 64):
        own = full[at : at + 64]
        wide = np.full((len(own), total[own].max()), -1, np.int64)
        wide[:, : edges.shape[1]] = edges[touched[own]]
        for i, k in enumerate(own):
            wide[i, size[k] : total[k]] = source[np.searchsorted(target, touched[k]) : np.searchsorted(target, touched[k], "right")]
        edges[touched[own]] = -1
        edges[touched[own], :DEGREE] = robust_prune(points, touched[own], wide)


def reached(edges: np.ndarray, entry: int) -> np.ndarray:
    found, front = np.zeros(len(edges), bool), np.array([entry])
    while len(front):
        found[front] = True
        front = np.unique(edges[front])
        front = front[(front >= 0) & ~found[front]]
    return found


def build_graph(points: np.ndarray) -> tuple[np.ndarray, int]:
    """(edges, entry) of points of one norm. The result depends on the points and their order only."""
    n = len(points)
    edges = np.full((n, SLACK), -1, np.int64)
    entry = int(np.argmax(points @ points.mean(0)))
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    done = 1
    while done < n:
        batch = order[done : done + min(done, TOGETHER)]
        near = beam_search(points, edges, entry, points[batch], min(BUILD_BEAM, max(done, 1)))
        chosen = robust_prune(points, batch, near)
        edges[batch, :DEGREE] = chosen
        _add_backwards(points, edges, batch, chosen)
        done += len(batch)
    while not (found := reached(edges, entry)).all():
        # each lost point: an edge from the nearest point that a search for it meets
        lost = np.flatnonzero(~found)[:TOGETHER]
        near = beam_search(points, edges, entry, points[lost], 1)[:, 0]
        for source, target in zip(near, lost):
            free = np.flatnonzero(edges[source] < 0)
            if not len(free):
                edges = np.concatenate([edges, np.full((n, 8), -1, np.int64)], 1)
                free = np.flatnonzero(edges[source] < 0)
            edges[source, free[0]] = target
    return edges[:, : max(1, (edges >= 0).sum(1).max(initial=1))], entry


def _one_norm(vectors: np.ndarray) -> np.ndarray:
    """Scaled, and with one more coordinate, so that all have the norm of the longest."""
    v = vectors / np.abs(vectors).max()
    squares = (v * v).sum(1)
    longest = squares.max()
    return (np.concatenate([v, np.sqrt(np.maximum(longest - squares, 0))[:, None]], 1) / np.sqrt(longest)).astype(np.float32)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _graph(key: tuple, table: pa.Table) -> pa.Table:
    dim, shard = (k.as_py() for k in key)
    vectors, ids = _matrix(table.column("vec"), dim), table.column("ids").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], vectors[i].tolist()))
    vectors = vectors[order]
    edges, entry = build_graph(_one_norm(vectors))
    return pa.table([[dim], [shard], [vectors.tobytes()], [edges.astype(np.int32).tobytes()], [entry], [[ids[i] for i in order]]], schema=GRAPH_ARROW)


def _answered(key: tuple, graphs: pa.Table, queries: pa.Table, k: int, beam: int) -> pa.Table:
    if not graphs.num_rows or not queries.num_rows:
        return FOUND_ARROW.empty_table()
    dim, g = key[0].as_py(), graphs.to_pylist()[0]
    vectors = np.frombuffer(g["points"], np.float64).reshape(-1, dim)
    edges = np.frombuffer(g["edges"], np.int32).reshape(len(vectors), -1).astype(np.int64)
    points, ids = _one_norm(vectors), g["ids"]
    asked, query_ids = _matrix(queries.column("vec"), dim), queries.column("query_id").to_pylist()
    scaled = asked / np.abs(asked).max(1, keepdims=True)
    scaled = np.concatenate([scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True)), np.zeros((len(asked), 1))], 1).astype(np.float32)
    found: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(asked), TOGETHER):
        held = beam_search(points, edges, g["entry"], scaled[at : at + TOGETHER], min(beam, len(points)))
        exact = np.where(held >= 0, np.einsum("qkd,qd->qk", vectors[np.maximum(held, 0)], asked[at : at + TOGETHER]), -np.inf)
        for query, own, scores in zip(query_ids[at : at + TOGETHER], held, exact):
            best: dict[int, float] = {}
            for score, i in sorted(((-s, i) for s, i in zip(scores.tolist(), own.tolist()) if i >= 0)):
                for j in ids[i]:
                    if j != query:
                        best.setdefault(j, -score)
            ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
            found[0].extend([query] * len(ranked))
            found[1].extend(x[0] for x in ranked)
            found[2].extend(x[1] for x in ranked)
    return pa.table(list(found), schema=FOUND_ARROW)


def valid_vectors(rows: DataFrame, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, vec) of the rows that take part, each once."""
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vec).alias("vec")).filter("id is not null and size(vec) > 0")
    odd = "exists(vec, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    return rows.filter(f"not {odd} and exists(vec, x -> x != 0)").distinct()


def shard_graphs(vectors: DataFrame, k: int, shard: int = SHARD) -> tuple[DataFrame, int]:
    """The graphs of all points, a row for each shard, and the number of shards. vectors: (id, vec)."""
    first = Window.partitionBy("vec").orderBy("id")
    few = vectors.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    points = written(few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    shards = max(1, -(-points.count() // shard))
    dealt = points.select(F.size("vec").alias("dim"), F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int").alias("shard"), "vec", "ids")
    return written(dealt.groupBy("dim", "shard").applyInArrow(_graph, GRAPH)), shards


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vec: str = "embedding", shard: int = SHARD, beam: int = QUERY_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest among all rows but those of its own id. queries: rows of the same columns."""
    graphs, shards = shard_graphs(valid_vectors(rows, vec_id, vec), k, shard)
    asked = written(valid_vectors(queries, vec_id, vec).select(F.col("id").alias("query_id"), "vec"))
    slices = max(1, -(-asked.count() // SLICE))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select(F.size("vec").alias("dim"), each(shards).alias("shard"), F.pmod(F.xxhash64("query_id", "vec"), F.lit(slices)).cast("int").alias("slice"), "query_id", "vec")
    keys = ("dim", "shard", "slice")
    sent = graphs.withColumn("slice", each(slices))
    found = sent.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(lambda key, g, q: _answered(key, g, q, k, max(beam, 2 * k)), FOUND)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


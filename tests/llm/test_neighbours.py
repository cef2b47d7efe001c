"""Neighbour graphs against brute force: recall, exact scores, ties among copies, several shards and slices, odd vectors."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from lineagelake.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, queries, k):
    """{query_id: [(vec_id, score)]} with ties to smaller ids; each id by its best vector."""
    out = {}
    for q, v in queries:
        best = {}
        for i, x in rows:
            if i != q and len(x) == len(v):
                score = float(np.dot(np.asarray(v, float), np.asarray(x, float)))
                best[i] = max(score, best.get(i, -math.inf))
        merged = dict(out.get(q, []))
        for i, s in best.items():
            merged[i] = max(s, merged.get(i, -math.inf))
        out[q] = sorted(merged.items(), key=lambda x: (-x[1], x[0]))
    return {q: own[:k] for q, own in out.items()}


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in own}) for q, own in want.items()) / sum(map(len, want.values()))


def test_query_recall_on_its_table(spark):
    d = "/root/testdata/sf0.1"
    got = answers(entry.queries()["op12_nearest_neighbours"](spark, d))
    t = pq.read_table(f"{d}/embeddings.parquet")
    ids, v = t["vec_id"].to_numpy(), np.stack(t["embedding"].to_numpy()).astype(float)
    asked = np.flatnonzero(ids % 20 == 0)
    scores = v[asked] @ v.T
    scores[np.arange(len(asked)), asked] = -np.inf
    top = np.argsort(-scores, 1, kind="stable")[:, :20]
    assert set(got) == set(ids[asked].tolist()) and all(len(own) == 20 for own in got.values())
    assert np.mean([len(set(ids[t].tolist()) & {i for i, _ in got[ids[q]]}) / 20 for q, t in zip(asked, top)]) >= 0.98
    at = {i: k for k, i in enumerate(ids.tolist())}
    for q, own in got.items():
        assert [(-s, i) for i, s in own] == sorted((-s, i) for i, s in own)
        assert all(abs(s - v[at[q]] @ v[at[i]]) < 1e-12 for i, s in own)


@pytest.mark.parametrize("lengths", [False, True])
def test_shards_slices_copies_and_lengths(spark, monkeypatch, lengths):
    monkeypatch.setattr(neighbours, "SLICE", 7)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=16)).astype(np.float32) * (1 + 9 * lengths * (i % 5))) for i in range(600)]
    rows[40] = (40, 60 * rows[40][1] / np.linalg.norm(rows[40][1]) * (1 + 9 * lengths))
    rows += [(1000 + i, rows[40][1]) for i in range(150)]  # a crowd of copies: ties go to the smaller ids
    rows += [(2000 + i, rows[41][1] + np.float32(1e-4) * rng.normal(size=16).astype(np.float32)) for i in range(150)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], SCHEMA)
    got = answers(neighbours.nearest(df, df.filter("vec_id % 20 = 0"), k=10, shard=150))
    want = brute(rows, [(i, v) for i, v in rows if i % 20 == 0], 10)
    assert set(got) == set(want) and recall(got, want) >= 0.95
    assert [i for i, _ in got[40]] == [i for i, _ in want[40]] == list(range(1000, 1010))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [1.0, 1.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, []), (7, [1.0, None]), (None, [1.0, 1.0]), (8, [3.0]), (40, [2.0, 0.0, 0.0]), (60, [0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as shard", "'x' as ids")
    got = answers(neighbours.nearest(df, df.filter("vec_id % 20 = 0")))
    assert got == {0: [(20, 1.0), (1, 0.5)], 20: [(0, 1.0), (1, 1.0)]}
    assert neighbours.nearest(df.limit(0), df).count() == 0 and neighbours.nearest(df, df.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [1e30, 1e-30]), (1, [1e38, 0.0]), (2, [-1e38, 1.0]), (3, [0.0, 1e-40])], SCHEMA)
    assert [i for i, _ in answers(neighbours.nearest(big, big.filter("vec_id = 0")))[0]] == [1, 3, 2]


def test_robust_prune_keeps_diverse_edges():
    rng = np.random.default_rng(2)
    points = neighbours._one_norm(rng.normal(size=(80, 6)))
    own, cand = np.arange(5), np.tile(np.arange(80), (5, 1))
    kept = neighbours.robust_prune(points, own, cand, degree=12)
    d = np.linalg.norm(points[:, None].astype(float) - points[None], axis=2)
    for p, edges in zip(own, kept):
        left, want = sorted((c for c in range(80) if c != p), key=lambda c: d[p, c]), []
        while left and len(want) < 12:
            best = left.pop(0)
            want.append(best)
            left = [c for c in left if neighbours.ALPHA * d[best, c] > d[p, c]]
        assert [e for e in edges if e >= 0] == want


def test_every_point_is_reached():
    rng = np.random.default_rng(3)
    clumps = np.concatenate([c + 1e-3 * rng.normal(size=(200, 8)) for c in rng.normal(size=(9, 8))])
    edges, start = neighbours.build_graph(neighbours._one_norm(clumps))
    assert neighbours.reached(edges, start).all()
    assert neighbours.build_graph(neighbours._one_norm(clumps[:1]))[0].shape[0] == 1

"""The pivot index: equal results, skipped block pairs, crowds of equal vectors, and connected groups."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from roadsift.operators import similarity as sim
from roadsift.operators.pivots import PivotIndex, farthest_points


def clustered(n=360, width=6, seed=0, unit=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width)) * 3
    v = centres[np.arange(n) % 12] + rng.normal(size=(n, width)) * 0.02
    v[:40] = v[0]  # a crowd of equal vectors
    return v / np.linalg.norm(v, axis=1, keepdims=True) if unit else v


def frame(spark, v, scenes=5):
    return spark.createDataFrame([(k, k % scenes, k // scenes, [float(x) for x in row]) for k, row in enumerate(v)], "id long, scene int, idx int, v array<double>").repartition(3)


def brute_knn(v, k, metric, scenes=5):
    d = 1 - v @ v.T if metric == "cosine" else np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    scene = np.arange(len(v)) % scenes
    d[scene[:, None] == scene[None]] = np.inf
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_neighbours_equal_brute_force_and_pairs_are_skipped(spark, metric):
    v = clustered(unit=metric == "cosine")
    df, report = frame(spark, v), {}
    got = sim.knn_distances(df, df, "id", "v", 4, metric, "scene", broadcast_bytes=0, block_rows=15, report=report)
    near = {r["id"]: r["near"] for r in got.collect()}
    want = brute_knn(v, 4, metric)
    assert len(near) == len(v) and np.allclose([near[k] for k in range(len(v))], want, atol=1e-7)
    assert report["compared"] < 0.5 * report["pairs"]  # twelve far clusters: most block pairs cannot hold a neighbour


def test_neighbours_without_enough_candidates_and_without_any(spark):
    v = clustered(60)
    df = frame(spark, v)
    got = {r["id"]: r["near"] for r in sim.knn_distances(df, df.filter("id < 3"), "id", "v", 5, "l2", "scene", broadcast_bytes=0, block_rows=8).collect()}
    assert len(got) == 60 and all(len(x) == sum(k % 5 != c % 5 for c in range(3)) for k, x in got.items())
    assert all(r["near"] == [] for r in sim.knn_distances(df, df.filter("id < 0"), "id", "v", 5, "l2", broadcast_bytes=0).collect())
    assert sim.knn_distances(df.filter("id < 0"), df, "id", "v", 5, "l2", broadcast_bytes=0).count() == 0


def test_gap_of_frames_in_one_scene(spark):
    v = clustered(90, unit=False)
    df = frame(spark, v, scenes=1)
    got = {r["id"]: r["near"] for r in sim.knn_distances(df, df, "id", "v", 3, "l2", "scene", "idx", 4, broadcast_bytes=0, block_rows=16).collect()}
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    d[np.abs(np.arange(90)[:, None] - np.arange(90)[None]) < 4] = np.inf
    assert np.allclose([got[k] for k in range(90)], np.sort(d, axis=1)[:, :3], atol=1e-7)


def test_blocks_stay_bounded_in_a_crowd(spark):
    v = np.tile([[1.0, 0.0]], (500, 1))
    index = PivotIndex.build(frame(spark, v), "v", ["id"], block_rows=16)
    rows = [r["rows"] for r in index.blocks.collect()]
    assert sum(rows) == 500 and max(rows) <= 16 and len(index.pivots) == 1


def test_similar_pairs_of_classes(spark):
    v = clustered()
    df, theta, report = frame(spark, v), 0.999, {}
    got = {(r["a"], r["b"]) for r in sim.similar_pairs(df, "id", "v", theta, block_rows=30, report=report).collect()}
    s = v @ v.T
    first = [0 if k < 40 else k for k in range(len(v))]
    want = {(first[a], first[b]) for a, b in itertools.combinations(range(len(v)), 2) if s[a, b] > theta and first[a] != first[b]}
    assert got == want and not any(a < 40 and b < 40 for a, b in got)
    assert report["compared"] < 0.5 * report["pairs"]
    row = sim.pair_redundancy(df, "id", "v", theta, block_rows=30).first()
    assert row["close"] == sum(s[a, b] > theta for a, b in itertools.combinations(range(len(v)), 2)) and row["n"] == len(v)


def test_a_crowd_makes_no_pairs(spark):
    df = frame(spark, np.tile([[0.6, 0.8]], (3000, 1)))
    assert sim.similar_pairs(df, "id", "v", 0.9).count() == 0
    assert {r["group"] for r in sim.duplicate_groups(df, "id", "v", 0.9).collect()} == {0}
    assert sim.pair_redundancy(df, "id", "v", 0.9).first()["redundancy"] == 1.0
    assert sim.duplicate_groups(df, "id", "v", 1.5).filter("id = group").count() == 3000


@pytest.mark.parametrize("tail", [0, 10**6])
def test_connected_groups_of_chains_stars_and_loops(spark, monkeypatch, tail):
    monkeypatch.setattr(sim, "TAIL", tail)
    edges = [(k, k + 1) for k in range(1, 60)] + [(1000, k) for k in range(1001, 1040)] + [(5000, 5000), (6001, 6000), (6001, 6000)]
    nodes = [*range(1, 61), *range(1000, 1040), 5000, 6000, 6001, 7000]
    df = spark.createDataFrame([(n,) for n in nodes], "id long")
    got = {r["id"]: r["group"] for r in sim.connected_groups(df, spark.createDataFrame(edges, "a long, b long"), "id").collect()}
    assert got == {n: 1 if n <= 60 else 1000 if n < 1040 else 6000 if n in (6000, 6001) else n for n in nodes}
    none = sim.connected_groups(df, spark.createDataFrame([], "a long, b long"), "id")
    assert none.filter("id = group").count() == len(nodes)


def test_farthest_points_leave_out_repeats():
    assert len(farthest_points(np.ones((5, 2)), 3)) == 1 and len(farthest_points(np.empty((0, 2)), 3)) == 0
    assert farthest_points(np.array([[0.0], [1.0], [5.0]]), 2).tolist() == [[0.0], [5.0]]

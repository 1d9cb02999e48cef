from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadsift.operators import evaluation as ev
from roadsift.operators import kernels as k
from roadsift.operators import matching as m
from roadsift.operators import pointcloud as pcl
from roadsift.operators import selection as sel
from roadsift.operators import similarity as sim


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_optimal(n, m_, seed):
    cost = np.random.default_rng(seed).integers(0, 20, (n, m_)).astype(float)
    got = k.assignment(cost)
    size = min(n, m_)
    assert len(got) == size == len({i for i, _ in got}) == len({j for _, j in got})
    small, big = (range(n), range(m_)) if n <= m_ else (range(m_), range(n))
    best = min(sum(cost[i, j] if n <= m_ else cost[j, i] for i, j in zip(small, p, strict=True)) for p in itertools.permutations(big, size))
    assert sum(cost[i, j] for i, j in got) == pytest.approx(best)


def naive_dbscan(x, eps, least):
    near = [np.flatnonzero(((x - p) ** 2).sum(1) <= eps * eps) for p in x]
    core = [len(v) >= least for v in near]
    label, c = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], c
            while stack:
                for j in near[stack.pop()]:
                    if label[j] < 0:
                        label[j] = c
                        if core[j]:
                            stack.append(j)
            c += 1
    return label


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 80), st.integers(0, 10_000))
def test_dbscan(n, seed):
    x = np.random.default_rng(seed).normal(0, 2, (n, 3))
    assert k.dbscan(x, 0.9, 4).tolist() == naive_dbscan(x, 0.9, 4).tolist()


def test_ground_plane_and_boxes():
    rng = np.random.default_rng(0)
    ground = np.column_stack([rng.uniform(-20, 20, (2000, 2)), rng.normal(-1.8, 0.03, 2000)])
    things = np.column_stack([rng.uniform(4, 6, (300, 2)), rng.uniform(-1, 1, 300)])
    plane = k.ground_plane(np.concatenate([ground, things]))
    assert plane is not None and abs(plane[2]) > 0.99 and abs(plane[3] - 1.8) < 0.1
    u, v = rng.uniform(-2, 2, 500), rng.uniform(-0.5, 0.5, 500)
    a = 0.6
    box = pcl.tight_box(np.column_stack([10 + u * np.cos(a) - v * np.sin(a), 3 + u * np.sin(a) + v * np.cos(a), rng.uniform(0, 1, 500)]))
    assert box[:2] == pytest.approx((10, 3), abs=0.1) and box[3:5] == pytest.approx((4, 1), abs=0.15) and box[6] == pytest.approx(a, abs=0.05)


def cloud(frame, seed, n=2600):
    rng = np.random.default_rng(seed)
    g = np.column_stack([rng.uniform(-30, 30, (n, 2)), rng.normal(-1.8, 0.02, n)])
    blobs = [np.column_stack([rng.normal(c, 0.15, (60, 2)), rng.uniform(-1.4, 0.2, 60)]) for c in ((5, 5), (-8, 2))]
    xyz = np.concatenate([g, *blobs])
    return pd.DataFrame({"sample_token": frame, "idx": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "intensity": rng.uniform(0, 255, len(xyz))})


def test_descriptors_and_candidates(spark):
    pts = spark.createDataFrame(pd.concat([cloud("a", 0), cloud("b", 1), cloud("c", 2, 500)]))
    rows = {r["sample_token"]: r for r in pcl.descriptors(pts).collect()}
    assert rows["a"]["keep"] and not rows["c"]["keep"] and rows["c"]["reason"] == "few_points"
    assert [len(rows["a"][b]) for b in pcl.BLOCKS] == [9, 16, 2500, 14, 3]
    assert sum(rows["a"]["range"][:8]) == pytest.approx(1)
    found = pcl.cluster_candidates(pts.filter("sample_token = 'a'")).collect()
    assert {(round(r["cx"]), round(r["cy"])) for r in found} >= {(5, 5), (-8, 2)}
    assert {r["cls_pred"] for r in found if r["dist_m"] < 9} <= {"pedestrian", "bicycle", "motorcycle", "vru_unknown", "other"}
    voxels = pcl.voxel_first(pts.filter("sample_token = 'a'"), "sample_token", "idx", 5.0).collect()
    want = cloud("a", 0)
    want["v"] = list(map(tuple, np.floor(want[["x", "y", "z"]].to_numpy() / 5).astype(int)))
    assert sorted(r["idx"] for r in voxels) == sorted(want.groupby("v")["idx"].min())
    boxes = spark.createDataFrame([("a", "o", 5.0, 5.0, -0.6, 2.0, 2.0, 2.0, 0.7)], "sample_token string, object_id string, cx double, cy double, cz double, l double, w double, h double, yaw double")
    assert pcl.points_in_boxes(pts, boxes, "sample_token", "object_id").first()["n_inside"] >= 60


def test_merge_track_flip(spark):
    cols = "sample_token string, cx double, cy double, cz double, l double, w double, h double, yaw double, pts int, cls_pred string"
    a = spark.createDataFrame([("f", 10.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0, 30, "other"), ("f", 20.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 5, "other")], cols)
    b = spark.createDataFrame([("f", 10.2, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0, 12, "pedestrian"), ("f", 5.0, 5.0, 0.0, 1.0, 1.0, 1.0, 0.0, 9, "bicycle")], cols)
    rows = {r["source"]: r for r in m.merge_candidates(a, b).collect()}
    assert rows["merged"]["pts"] == 30 and rows["merged"]["cls_pred"] == "pedestrian" and rows["merged"]["cx"] == 10.2
    assert rows["cluster"]["missed_by_model"] and rows["detector"]["object_id"] == "o000"
    seq = [("s", "f0", 0, "o0", 0.0, 0.0), ("s", "f0", 0, "o1", 50.0, 0.0), ("s", "f1", 500_000, "o0", 1.0, 0.0), ("s", "f1", 500_000, "o1", 90.0, 0.0), ("s", "f2", 1_000_000, None, None, None), ("s", "f3", 1_500_000, "o0", 1.0, 0.0)]
    t = {(r["sample_token"], r["object_id"]): r for r in m.track(spark.createDataFrame(seq, "scene_token string, sample_token string, timestamp long, object_id string, gx double, gy double")).collect()}
    assert t["f0", "o0"]["track_id"] == t["f1", "o0"]["track_id"] and t["f0", "o0"]["speed_mps"] == t["f1", "o0"]["speed_mps"] == 2.0
    assert t["f1", "o1"]["track_id"] != t["f0", "o1"]["track_id"] and t["f1", "o1"]["speed_mps"] is None
    assert t["f3", "o0"]["track_id"] != t["f1", "o0"]["track_id"]  # an empty frame ends tracks
    d = "sample_token string, cx double, cy double, label int, score double"
    x, y = spark.createDataFrame([("f", 0.0, 0.0, 1, 0.9), ("f", 9.0, 0.0, 1, 0.8)], d), spark.createDataFrame([("f", 0.5, 0.0, 1, 0.7)], d)
    assert m.flip_matches(x, y).first()["inc"] == 0.5


def test_detection_events_and_ap(spark):
    o = spark.createDataFrame([("s", "c", "v", 0.0, 0.0, 10.0, 10.0, False), ("s", "c", "v", 50.0, 0.0, 60.0, 10.0, False), ("s", "c", "v", 90.0, 0.0, 99.0, 10.0, True)], "sample_token string, cam string, `group` string, x1 double, y1 double, x2 double, y2 double, ignore boolean")
    d = spark.createDataFrame([("s", "c", "v", 0.0, 0.0, 10.0, 10.0, 0.9), ("s", "c", "v", 20.0, 20.0, 30.0, 30.0, 0.8), ("s", "c", "v", 50.0, 0.0, 60.0, 10.0, 0.7), ("s", "c", "v", 90.0, 0.0, 99.0, 10.0, 0.6)], "sample_token string, cam string, `group` string, x1 double, y1 double, x2 double, y2 double, score double")
    e = m.detection_events(o, d)
    assert [(r["score"], r["hit"]) for r in e.orderBy(F.desc("score")).collect()] == [(0.9, True), (0.8, False), (0.7, True)]
    assert ev.average_precision(e, 2, "score", "hit", "ord").first()["ap"] == pytest.approx((51 + 50 * 2 / 3) / 101)
    assert ev.average_precision(e, 0, "score", "hit", "ord").first()["ap"] is None


def test_statistics_hand_values(spark):
    p = spark.createDataFrame([("a", 0.03), ("b", 0.01), ("c", 0.04)], "k string, p double")
    assert {r["k"]: round(r["p_holm"], 6) for r in ev.holm(p, "k", "p").collect()} == {"a": 0.06, "b": 0.03, "c": 0.06}
    same = spark.createDataFrame([(True, True), (False, False)], "a boolean, b boolean")
    assert ev.cohen_kappa(same, "a", "b").first()["kappa"] == 1
    crossed = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "a boolean, b boolean")
    assert ev.cohen_kappa(crossed, "a", "b").first()["kappa"] == 0
    assert ev.cohen_kappa(same.limit(0), "a", "b").first()["kappa"] == 0
    one = spark.createDataFrame([(0.3, True), (0.6, True)], "s double, p boolean")
    assert ev.auroc(one, "s", "p").first()["auroc"] == 0.5
    pool = spark.createDataFrame([(str(i), i < 3, f"s{i // 2}") for i in range(6)], "t string, rare boolean, scene string")
    r = ev.selection_metrics(pool, pool.filter("t in ('0', '5')"), "t", "rare", "scene").first()
    assert (r["recall"], r["n_recall"], r["uplift"], r["precision"]) == pytest.approx((1 / 3, 1 / 2, 1, 1 / 2))


def test_duplicates_and_novelty_hand_values(spark):
    a = np.arccos(0.97)
    v = [(i, "s", [np.cos(t), np.sin(t), 0.0]) for i, t in enumerate((0, a, 2 * a))] + [(3, "s", [0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, s, [float(x) for x in z]) for i, s, z in v], "i long, s string, z array<double>")
    assert {r["i"]: r["group"] for r in sim.duplicate_groups(df, "i", "z", 0.95).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    eye = spark.createDataFrame([(i, f"s{i}", 0, np.eye(3)[i].tolist()) for i in range(3)], "i long, s string, f int, z array<double>")
    assert [r["nov_knn"] for r in sim.novelty_knn(eye, "i", "z", "s", "f").collect()] == pytest.approx([1, 1, 1])
    line = spark.createDataFrame([(0, "a", True, [0.0]), (1, "b", True, [10.0]), (2, "c", True, [10.2])], "i long, s string, ok boolean, z array<double>")
    near = lambda d: {r["i"]: r["rarity"] for r in sim.rarity_knn(d, "i", "z", "s", "ok", 1).collect()}[0]
    assert near(line) == pytest.approx(10) and near(line.withColumn("ok", F.col("i") != 1)) == pytest.approx(10.2)


def test_pca_equals_dense(spark):
    rng = np.random.default_rng(3)
    a, b, keep = rng.normal(0, 3, (40, 4)), rng.normal(1, 1, (40, 2)) @ np.array([[1, 0.5], [0, 1]]), rng.random(40) > 0.2
    df = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist(), bool(keep[i])) for i in range(40)], "i long, a array<double>, b array<double>, keep boolean")
    got = np.asarray([r["embedding"] for r in sim.embed_blocks(df, "i", ["a", "b"], "keep", 3).orderBy("i").collect()])
    x = np.concatenate([(m_ - m_[keep].mean(0)) / m_[keep].std(0) / np.sqrt(m_.shape[1]) for m_ in (a, b)], axis=1)
    _, _, vt = np.linalg.svd(x[keep] - x[keep].mean(0), full_matrices=False)
    axes = vt[:3].T * np.sign(vt[:3][np.arange(3), np.abs(vt[:3]).argmax(1)])
    assert got == pytest.approx((x - x[keep].mean(0)) @ axes, abs=1e-8)


def test_rare_selection(spark):
    rng = np.random.default_rng(5)
    rows = [(f"t{i:02d}", float(rng.random()), rng.standard_normal(4).tolist(), f"s{i % 4}", i // 4, i != 7) for i in range(24)]
    df = spark.createDataFrame(rows, "t string, s double, z array<double>, scene string, f int, ok boolean")
    out, warnings = sel.rare_select(df, "t", "s", "z", "scene", "f", "ok", df.filter("t in ('t01', 't02')").select("t"), 8)
    got = out.orderBy("rank").collect()
    assert len(got) == 23 and sum(r["selected"] for r in got) == 8 and not warnings
    assert "t07" not in {r["t"] for r in got} and not {"t01", "t02"} & {r["t"] for r in got if r["selected"]}
    assert max(pd.Series([r["t"] for r in got if r["selected"]]).map({r[0]: r[3] for r in rows}).value_counts()) <= 2
    assert sel.rare_select(df.filter("false"), "t", "s", "z", "scene", "f", "ok", df.limit(0), 3)[1] == ["ELIGIBLE_ZERO"]


def test_ground_is_below_what_counts():
    """Slopes up to 0.8, all near points as inliers, returns below the plane are ground, and no plane means no clusters."""
    rng = np.random.default_rng(0)
    xy = rng.uniform(-20, 20, (4000, 2))
    slope = np.column_stack([xy, -1.7 + 0.6 * xy[:, 0]])
    plane = k.ground_plane(slope)
    assert plane[2] == pytest.approx(1 / np.hypot(1, 0.6), abs=1e-3) and plane[0] == pytest.approx(-0.6 / np.hypot(1, 0.6), abs=1e-3)
    assert k.ground_plane(np.column_stack([xy, 2.0 * xy[:, 0]])) is None
    cfg = pcl.CloudConfig()
    flat = np.column_stack([xy, np.full(4000, -1.7)])
    below = np.column_stack([rng.uniform(5, 6, (60, 2)), rng.uniform(-4, -3, 60)])
    car = np.column_stack([rng.uniform(9, 11, 200), rng.uniform(3, 5, 200), rng.uniform(-1, 0, 200)])
    blocks = pcl.frame_blocks(np.concatenate([flat, below, car]), np.zeros(4260), cfg)
    assert np.expm1(blocks["clusters"][0]) == pytest.approx(1) and len(blocks["clusters"]) == 14  # the car alone
    near = np.column_stack([rng.uniform(1, 2, 50), rng.uniform(1, 2, 50), rng.uniform(0, 1, 50)])
    blocks = pcl.frame_blocks(np.concatenate([flat, near]), np.full(4050, 51.0), cfg)
    voxels = len(np.unique(np.floor(np.concatenate([flat, near]) / 0.2).astype(int), axis=0))
    own = len(np.unique(np.floor(near / 0.2).astype(int), axis=0))
    assert blocks["sensor"][0] == pytest.approx(own / voxels) and blocks["sensor"][1] == pytest.approx(0.2)
    wall = np.column_stack([np.linspace(1.5, 8, 3000), rng.uniform(0, 0.01, 3000), rng.uniform(-3, 5, 3000)])
    assert not pcl.frame_blocks(wall, np.zeros(3000), cfg)["clusters"].any()

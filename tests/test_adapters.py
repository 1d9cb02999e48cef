from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadsift.operators import adapters as ad
from roadsift.operators import labels, projection
from roadsift.schemas import ContractError, validate


def test_motion_and_mounting(spark):
    rows = [("a", k * 0.5, k * 2.0, 0.0, math.pi - 0.1) for k in range(6)] + [("b", k * 0.5, 1.0, 1.0, 0.0) for k in range(4)]
    poses = spark.createDataFrame(rows, "log string, t double, x double, y double, yaw double")
    m = ad.ego_motion(poses)
    got = {r["log"]: r for r in m.groupBy("log").agg(F.bool_and("moving").alias("all"), F.bool_or("moving").alias("any"), F.max(F.abs("heading")).alias("h")).collect()}
    assert got["a"]["all"] and got["a"]["h"] == pytest.approx(0) and not got["b"]["any"]
    delta = {r["log"]: r["delta"] for r in ad.mounting_delta(m).collect()}
    assert delta["a"] == pytest.approx(-math.pi + 0.1) and delta["b"] is None
    with pytest.raises(ContractError):
        ad.check_headings(m, "yaw")
    with pytest.raises(ContractError):
        ad.ego_motion(poses.union(poses))
    tracks = spark.createDataFrame([("u", k * 0.5, 3.0 * k, 0.0, math.pi + 0.01) for k in range(5)], "uuid string, t double, x double, y double, yaw double")
    assert ad.check_track_headings(tracks) == pytest.approx(math.degrees(0.01), abs=1e-6)
    with pytest.raises(ContractError):
        ad.check_track_headings(tracks.withColumn("yaw", F.col("yaw") + math.pi / 2))


def test_box_axes(spark):
    rng = np.random.default_rng(0)
    p = [("f", float(5 + x), float(y), 0.0) for x, y in zip(rng.uniform(-2, 2, 200), rng.uniform(-0.8, 0.8, 200), strict=True)]
    points = spark.createDataFrame(p, "sample_token string, x double, y double, z double")
    box = lambda l, w, yaw: spark.createDataFrame([("f", "b", "vehicle.car", 5.0, 0.0, 0.0, l, w, 2.0, yaw)], "sample_token string, box_id string, category string, cx double, cy double, cz double, l double, w double, h double, yaw double")
    assert ad.check_box_axes(ad.box_axis_errors(points, box(4.2, 1.8, 0.05))) == 1
    with pytest.raises(ContractError):
        ad.check_box_axes(ad.box_axis_errors(points, box(1.8, 4.2, 0.0)))  # length and width swapped
    assert ad.yaw_offset({0.0: [2.0, 3.0], math.pi: [2.0, 3.0], math.pi / 2: [88.0], -math.pi / 2: [88.0]}) == 0.0
    with pytest.raises(ContractError):
        ad.yaw_offset({0.0: [80.0], math.pi / 2: [70.0]})


def test_small_adapters(spark):
    assert ad.camera_slots({"a": 0.0, "b": 50.0, "c": -50.0, "d": 179.0, "e": 100.0, "g": -100.0})["CAM_BACK"] == "d"
    k, window = ad.crop_intrinsic([[1000, 0, 800], [0, 1000, 600], [0, 0, 1]], 1600, 1200)
    assert window == (0, 150, 1600, 1050) and k[1][2] == 450
    b = spark.createDataFrame([("u", 0), ("u", 1), ("v", 1)], "uuid string, sensor_id int")
    assert sorted(map(tuple, ad.prefer_source(b).collect())) == [("u", 0), ("v", 1)]
    frames = spark.createDataFrame([("s", "c", "p"), ("s", "d", "q")], "sample_token string, cam string, img_path string")
    boxes = spark.createDataFrame([("s", "c", "vehicle.car", 0.0, 0.0, 10.0, 10.0), ("s", "c", "animal", 0.0, 0.0, 9.0, 9.0), ("s", "c", "vehicle.car", 0.0, 0.0, 9.0, 5.0)], "sample_token string, cam string, category string, x1 double, y1 double, x2 double, y2 double")
    rows = {r["img_path"]: r for r in ad.train_set(frames, boxes, {"vehicle.": 3}).collect()}
    assert rows["p"]["labels"] == [3] and rows["q"]["boxes"] == []
    img = spark.createDataFrame([("s", 5.0, 10.0), ("s", 3.0, 20.0), ("t", 9.0, 1.0)], "sample_token string, q_blur double, q_bright double")
    f = ad.rival_features(img, spark.createDataFrame([("s", 0.7)], "sample_token string, unc double"), spark.createDataFrame([("s", 0, 0.9), ("s", 2, 0.9), ("t", 1, 0.2)], "sample_token string, cls int, conf double"))
    assert {r["sample_token"]: tuple(r)[1:] for r in f.collect()} == {"s": (3.0, 15.0, 0.7, 1), "t": (9.0, 1.0, 0.0, 0)}
    assert [ad.rival(f, n, 1).first()["sample_token"] for n in ("entropy", "crowd", "blur", "dark")] == ["s", "s", "s", "t"]
    assert len(frames.select(ad.hashed_token("sample_token", "cam").alias("t")).distinct().collect()) == 2


def numpy_project(center, size, q, ego, cam, k):
    def m(q):
        w, x, y, z = np.asarray(q) / np.linalg.norm(q)
        return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])

    w, l, h = size
    signs = np.array([(a, b, c) for a in (1, -1) for b in (1, -1) for c in (1, -1)]) / 2
    p = (m(q) @ (signs * [l, w, h]).T).T + center
    p = (p - ego[1]) @ m(ego[0])
    p = (p - cam[1]) @ m(cam[0])
    uv = p @ np.asarray(k).reshape(3, 3).T
    return uv[:, :2] / uv[:, 2:], p[:, 2]


def test_projection(spark):
    # a camera that looks along +x of the ego frame
    cam_q, cam_t, k = [0.5, -0.5, 0.5, -0.5], [1.5, 0.0, 1.6], [1000.0, 0.0, 800.0, 0.0, 1000.0, 450.0, 0.0, 0.0, 1.0]
    ego_q, ego_t = [math.cos(0.2), 0.0, 0.0, math.sin(0.2)], [10.0, 5.0, 0.0]
    box = ([10 + 20 * math.cos(0.4), 5 + 20 * math.sin(0.4), 1.0], [2.0, 4.5, 1.6], [math.cos(0.5), 0.0, 0.0, math.sin(0.5)])
    behind = ([-20.0, -10.0, 1.0], box[1], box[2])
    boxes = spark.createDataFrame([("s", n, "vehicle.car", *b, "4", 9) for n, b in (("a", box), ("b", behind))], "sample_token string, ann_token string, category string, translation array<double>, size array<double>, rotation array<double>, visibility string, num_lidar_pts int")
    cams = spark.createDataFrame([("s", "CAM_FRONT", ego_q, ego_t, cam_t, cam_q, k)], "sample_token string, cam string, ego_q array<double>, ego_t array<double>, translation array<double>, rotation array<double>, intrinsic array<double>")
    out = projection.project_boxes(boxes, cams)
    validate(out, "gt_boxes_2d")
    row = out.collect()
    uv, z = numpy_project(*box, (ego_q, ego_t), (cam_q, cam_t), k)
    assert [r["ann_token"] for r in row] == ["a"] and (z > 0).all()
    assert [row[0][c] for c in ("x1", "y1", "x2", "y2")] == pytest.approx([*np.clip(uv.min(0), 0, [1600, 900]), *np.clip(uv.max(0), 0, [1600, 900])])
    assert row[0]["depth"] == pytest.approx(18.5) and len(row[0]["corners"]) == 16
    ego = projection.boxes_in_ego(boxes, cams).filter("ann_token = 'a'").first()["corners"]
    assert np.reshape(ego, (8, 3)).mean(0) == pytest.approx([20, 0, 1])
    objs = spark.createDataFrame([("s", "o", 20.0, 0.0, 1.0, 4.5, 2.0, 1.6, 0.6), ("s", "far", -20.0, 0.0, 1.0, 1.0, 1.0, 1.0, 0.0)], "sample_token string, object_id string, cx double, cy double, cz double, l double, w double, h double, yaw double")
    seen = projection.project_objects(objs, cams).collect()
    assert [(r["object_id"], r["cam"]) for r in seen] == [("o", "CAM_FRONT")] and seen[0]["visible_frac"] == pytest.approx(1)


def test_rhcio_labels(spark):
    frames = spark.createDataFrame([(f"t{k}", f"s{k // 5}", "V" if k < 10 else "P", "Night" if k % 5 == 0 else "Day") for k in range(20)], "sample_token string, scene_token string, split string, scene_desc string")
    rows = []
    for k in range(20):
        rows.append((f"t{k}", f"i{k // 5}", "human.pedestrian.adult", "pedestrian", 20, 10.0 + k % 3, 10.0, 1.0, 0.9, ["walking"]))
    rows.append(("t3", "rare", "vehicle.bicycle", "bicycle", 4, 35.0, 30.0, 9.0, 0.1, ["riding"]))
    rows.append(("t15", "new", "vehicle.motorcycle", "motorcycle", 20, 12.0, 30.0, 9.0, None, []))
    boxes = spark.createDataFrame(rows, "sample_token string, instance_token string, category string, vru_group string, num_lidar_pts int, dist_m double, x double, y double, speed_mps double, attributes array<string>")
    frame, instance = labels.rhcio_labels(boxes, frames)
    validate(frame, "gt_rhcio_frame")
    validate(instance, "gt_rhcio_instance")
    f = {r["sample_token"]: r for r in frame.collect()}
    # with ten V frames the 'higher' 0.9 quantile is the largest value, so nothing in V is above it
    assert not f["t3"]["r1_class"] and f["t3"]["h_hard"] and f["t3"]["i_conflict"] and not f["t15"]["r1_class"] and f["t15"]["unknown"] and f["t0"]["c_night"]
    loose, _ = labels.rhcio_labels(boxes, frames, alpha=0.5)
    assert {r["sample_token"] for r in loose.filter("r1_class").collect()} == {"t3"}
    i = {r["instance_token"]: r for r in instance.collect()}
    assert i["i0"]["n_frames_visible"] == 5 and "i_conflict" in i["i0"]["axes"] and i["rare"]["frames"] == "t3"


def test_load_boxes(spark):
    ann = spark.createDataFrame([(f"a{k}", f"t{k}", "i", "vehicle.bicycle", [5.0 + 2 * k, 3.0, 0.0], ["m"]) for k in range(3)] + [("c", "t0", "car", "vehicle.car", [0.0, 0.0, 0.0], [])], "token string, sample_token string, instance_token string, category string, translation array<double>, attribute_tokens array<string>")
    half = math.sqrt(0.5)
    egos = spark.createDataFrame([(f"t{k}", [half, 0.0, 0.0, half], [5.0, 0.0, 0.0]) for k in range(3)], "sample_token string, ego_q array<double>, ego_t array<double>")
    times = spark.createDataFrame([(f"t{k}", k * 500_000) for k in range(3)], "sample_token string, timestamp long")
    out = {r["sample_token"]: r for r in labels.load_boxes(ann, egos, times, spark.createDataFrame([("m", "moving")], "token string, name string")).collect()}
    assert len(out) == 3 and out["t1"]["speed_mps"] == pytest.approx(4) and out["t0"]["attributes"] == ["moving"]
    assert (out["t0"]["x"], out["t0"]["y"]) == pytest.approx((3, 0)) and out["t1"]["dist_m"] == pytest.approx(math.hypot(2, 3))

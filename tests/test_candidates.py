"""Candidates in the vehicle's frame against hand-computed boxes, places and tracks."""

import math

import numpy as np
import pandas as pd
import pytest

from roadsift.operators import candidates as cand
from roadsift.operators import pointcloud as pcl

R_BACK = [0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0]  # a quarter turn to the right
T = [1.0, 0.0, 2.0]
DETECTION = "sample_token string, cx double, cy double, cz double, l double, w double, h double, yaw double, label int, score double"


def sweep(frame, at, spin=0.0):
    """Flat ground and a grid of 4 x 1 x 0.6 m, turned by ``spin``, around ``at`` in the sensor's frame."""
    gx, gy = (v.ravel() for v in np.meshgrid(np.arange(-20, 20, 0.5), np.arange(-20, 20, 0.5)))
    ground = np.column_stack([gx, gy, np.full(len(gx), -1.8)])
    u, v, z = (x.ravel() for x in np.meshgrid(np.linspace(-2, 2, 17), np.linspace(-0.5, 0.5, 5), [0.0, 0.3, 0.6], indexing="ij"))
    c, s = math.cos(spin), math.sin(spin)
    box = np.column_stack([at[0] + c * u - s * v, at[1] + s * u + c * v, z])
    xyz = np.concatenate([ground, box])
    return pd.DataFrame({"sample_token": frame, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})


def test_boxes_are_measured_in_the_vehicle_frame(spark):
    spins = {"straight": 0.0, "turned": math.radians(30)}
    pts = spark.createDataFrame(pd.concat([sweep(k, (10, 5), a) for k, a in spins.items()]))
    cal = spark.createDataFrame([(k, R_BACK, T) for k in [*spins, "no points"]], "sample_token string, R array<double>, t array<double>")
    found = {r["sample_token"]: r for r in pcl.cluster_candidates(pts, calibration=cal).collect()}
    assert set(found) == set(spins)
    for name, spin in spins.items():
        r = found[name]
        assert (r["cx"], r["cy"], r["cz"]) == pytest.approx((5 + 1, -10, 0.3 + 2), abs=1e-6)
        assert (r["l"], r["w"], r["h"]) == pytest.approx((4, 1, 0.6), abs=1e-6)
        assert abs(math.cos(r["yaw"] - (spin - math.pi / 2))) == pytest.approx(1, abs=1e-9)  # the main axis, modulo pi
        assert r["pts"] == 17 * 5 * 3 and r["object_id"] == "c000" and r["dist_m"] == pytest.approx(math.hypot(6, 10))


def test_without_calibration_boxes_follow_the_sensor_axes(spark):
    spin = math.radians(30)
    pts = spark.createDataFrame(sweep("f", (10, 5), spin))
    cal = spark.createDataFrame([("other", R_BACK, T)], "sample_token string, R array<double>, t array<double>")
    rows = [*pcl.cluster_candidates(pts).collect(), *pcl.cluster_candidates(pts, calibration=cal).filter("sample_token = 'f'").collect()]
    for r in rows:
        wide, deep = 4 * math.cos(spin) + math.sin(spin), 4 * math.sin(spin) + math.cos(spin)
        assert (r["cx"], r["cy"], r["l"], r["w"]) == pytest.approx((10, 5, wide, deep), abs=1e-6) and abs(math.cos(r["yaw"] - spin)) == pytest.approx(1)
    assert len(rows) == 2


def test_detector_boxes(spark):
    rows = [("f", 5.0, 3.0, 0.5, 4.0, 2.0, 1.5, 3.0, 1, 0.3), ("f", 1.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 9, 0.9), ("f", 1.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 1, 0.29), ("g", 1.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.5, 2, 0.9)]
    cal = spark.createDataFrame([("f", [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], T)], "sample_token string, R array<double>, t array<double>")
    out = cand.detector_candidates(spark.createDataFrame(rows, DETECTION), ["Ped", "Van"], {"Ped": "pedestrian"}, cal).orderBy("sample_token", "cz").collect()
    assert len(out) == 3 and [r["cls_pred"] for r in out] == ["other", "pedestrian", "other"]
    assert (out[1]["cx"], out[1]["cy"], out[1]["cz"]) == pytest.approx((-3 + 1, 5, 2.5)) and out[1]["yaw"] == pytest.approx(3 + math.pi / 2 - 2 * math.pi)
    assert (out[2]["cx"], out[2]["yaw"]) == (1.0, 0.5)  # no calibration: as detected
    assert cand.detector_candidates(spark.createDataFrame(rows, DETECTION), [], {}).filter("cls_pred <> 'other'").isEmpty()


def test_candidates_of_a_scene(spark):
    # the vehicle moves 1 m along x between the frames, the object 2 m away from it
    pts = spark.createDataFrame(pd.concat([sweep("a", (10, 5)), sweep("b", (10, 6)), sweep("skipped", (10, 5))]))
    cal = spark.createDataFrame([(k, R_BACK, T) for k in ("a", "b")], "sample_token string, R array<double>, t array<double>")
    index = spark.createDataFrame([("a", "s", 0, 100.0, 50.0, 0.0, True), ("b", "s", 1_000_000, 101.0, 50.0, 0.0, True), ("skipped", "s", 2_000_000, 0.0, 0.0, 0.0, False)], "sample_token string, scene_token string, timestamp long, ego_x double, ego_y double, ego_yaw double, keep boolean")
    det = spark.createDataFrame([("a", 10.1, 5.0, 0.3, 4.0, 1.0, 0.6, 0.0, 1, 0.8), ("b", -0.5, 2.5, 0.0, 1.0, 1.0, 1.0, 0.0, 1, 0.8), ("skipped", 10.0, 5.0, 0.0, 4.0, 1.0, 1.0, 0.0, 1, 0.8)], DETECTION)
    rows = {(r["sample_token"], r["source"]): r for r in cand.object_candidates(pts, index, cal, det, ["Ped"], {"Ped": "pedestrian"}).collect()}
    assert set(rows) == {("a", "merged"), ("b", "cluster")}  # the second detection lies on the vehicle itself
    one, two = rows["a", "merged"], rows["b", "cluster"]
    assert (two["gx"], two["gy"]) == pytest.approx((101 + 6 + 1, 50 - 10)) and two["missed_by_model"] and two["pts"] == 255
    assert one["track_id"] == two["track_id"] and one["speed_mps"] == two["speed_mps"] == pytest.approx(math.hypot(two["gx"] - one["gx"], two["gy"] - one["gy"]))
    alone = cand.object_candidates(pts, index, cal).collect()
    assert {r["source"] for r in alone} == {"cluster"} and not any(r["missed_by_model"] for r in alone)
    turned = cand.in_world(spark.createDataFrame([("a", 2.0, 1.0)], "sample_token string, cx double, cy double"), index.withColumn("ego_yaw", index.ego_yaw + math.pi / 2)).first()
    assert (turned["gx"], turned["gy"]) == pytest.approx((99, 52))

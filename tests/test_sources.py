from __future__ import annotations

import json
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadsift.operators import joins, splits
from roadsift.schemas import CAMERAS, ContractError, validate
from roadsift.sources import encoders, metadata, tables


def write_dataset(root, scenes=2, frames=6):
    """A small recording: samples in reverse order, one non-key sweep a frame, two boxes a frame."""
    t: dict[str, list] = {k: [] for k in (*metadata.REQUIRED, "log", "category", "instance", "sample_annotation", "visibility", "attribute")}
    half = math.sqrt(0.5)
    for cam in (*CAMERAS, "LIDAR_TOP"):
        t["sensor"].append({"token": f"sen-{cam}", "channel": cam, "modality": "camera" if cam != "LIDAR_TOP" else "lidar"})
        t["calibrated_sensor"].append({"token": f"cal-{cam}", "sensor_token": f"sen-{cam}", "translation": [1.0, 0.0, 1.5], "rotation": [half, 0.0, 0.0, half], "camera_intrinsic": [[1000.0, 0.0, 800.0], [0.0, 1000.0, 450.0], [0.0, 0.0, 1.0]] if cam != "LIDAR_TOP" else []})
    t["log"].append({"token": "log", "logfile": "l", "vehicle": "v", "date_captured": "2024-01-01", "location": "here"})
    t["category"].append({"token": "cat", "name": "vehicle.bicycle", "description": ""})
    for s in range(scenes):
        tokens = [f"s{s}f{k}" for k in range(frames)]
        t["scene"].append({"token": f"scene{s}", "name": f"scene-{s:04d}", "description": "Night, rain", "log_token": "log", "nbr_samples": frames, "first_sample_token": tokens[0], "last_sample_token": tokens[-1]})
        t["instance"].append({"token": f"inst{s}", "category_token": "cat", "nbr_annotations": frames, "first_annotation_token": "", "last_annotation_token": ""})
        for k, tok in enumerate(tokens):
            t["sample"].insert(0, {"token": tok, "timestamp": 1_000_000 * (10 * s + k), "scene_token": f"scene{s}", "prev": tokens[k - 1] if k else "", "next": tokens[k + 1] if k + 1 < frames else ""})
            t["sample_annotation"].append({"token": f"ann-{tok}", "sample_token": tok, "instance_token": f"inst{s}", "attribute_tokens": [], "visibility_token": "1", "num_lidar_pts": k, "num_radar_pts": 0, "translation": [5.0, 0.0, 0.0], "size": [1.0, 2.0, 1.5], "rotation": [1.0, 0.0, 0.0, 0.0], "prev": "", "next": ""})
            t["ego_pose"].append({"token": f"ego-{tok}", "timestamp": 0, "rotation": [half, 0.0, 0.0, half], "translation": [float(k), 2.0, 0.0]})
            for cam in (*CAMERAS, "LIDAR_TOP"):
                ext = "jpg" if cam != "LIDAR_TOP" else "bin"
                for key in (True, False):
                    name = f"samples/{cam}/{tok}.{ext}" if key else f"sweeps/{cam}/{tok}.{ext}"
                    t["sample_data"].append({"token": f"sd-{tok}-{cam}-{key}", "sample_token": tok, "ego_pose_token": f"ego-{tok}", "calibrated_sensor_token": f"cal-{cam}", "timestamp": 0, "fileformat": ext, "is_key_frame": key, "filename": name, "width": 1600, "height": 900, "prev": "", "next": ""})
                    os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
                    if key and not (cam == "CAM_BACK" and tok == "s0f0"):
                        body = np.random.default_rng(k).uniform(-30, 30, (50, 5)).astype(np.float32).tobytes() if ext == "bin" else b"x"
                        open(f"{root}/{name}", "wb").write(body)
    os.makedirs(f"{root}/v1.0-mini")
    for name, rows in t.items():
        json.dump(rows, open(f"{root}/v1.0-mini/{name}.json", "w"))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("rec"))
    write_dataset(folder)
    return folder


def test_metadata(spark, root):
    t = metadata.load_tables(spark, root)
    assert metadata.has_annotations(t)
    metadata.check_chains(spark, t)
    files = metadata.existing_files(spark, root, "*.jpg")
    frames = metadata.frame_index(spark, t, files).persist()
    assert frames.count() == 2 * 6 * 6 - 1
    first = frames.filter("scene_token = 'scene0' and frame_idx = 1").collect()
    assert [r["cam"] for r in first] == list(CAMERAS) and {r["sample_token"] for r in first} == {"s0f1"}
    validate(frames, "frames")
    poses = metadata.camera_poses(t, frames)
    assert validate(poses, "cam_poses").first()["intrinsic"][:3] == [1000.0, 0.0, 800.0]
    index = metadata.lidar_index(spark, t)
    row = index.filter("sample_token = 's1f3'").first()
    assert (row["frame_idx"], row["ego_x"]) == (3, 3.0) and row["ego_yaw"] == pytest.approx(math.pi / 2)
    validate(index, "lidar_index")
    cal = metadata.lidar_calibration(t, index)
    assert validate(cal, "lidar_calib").count() == 12
    assert metadata.lidar_calibration(t, index.limit(2), cal).count() == 2
    sun = metadata.sun_inputs(t, {"here": (42.0, -71.0)}).first()
    assert (sun["lat"], sun["lon"]) == (42.0, -71.0)
    sub = splits.sub_dataset(t, spark.createDataFrame([("scene-0001",)], "name string"))
    assert sub["sample"].count() == 6 and sub["sample_annotation"].count() == 6 and sub["sample_data"].count() == 6 * 14


def test_versions_and_clouds(spark, root, tmp_path):
    with pytest.raises(FileNotFoundError):
        metadata.version_folder(spark, str(tmp_path))
    os.makedirs(tmp_path / "v1.0-a")
    os.makedirs(tmp_path / "v1.0-b")
    with pytest.raises(ContractError):
        metadata.version_folder(spark, str(tmp_path))
    open(tmp_path / "bad.bin", "wb").write(b"123")
    assert tables.clouds(spark, f"{root}/samples/LIDAR_TOP").groupBy("path").count().filter("count = 50").count() == 12
    assert tables.clouds(spark, str(tmp_path)).first()["idx"] is None


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1234567, 0.5, 3, 0.25), ("b", 1.0, 0.0, 0, 0.75)], "sample_token string, ent double, inc double, n_det int, nov double")
    for ext in ("parquet", "csv"):
        path = f"{tmp_path}/t.{ext}"
        m = tables.write_table(df, path, "t1_signals", source="test")
        assert m["rows"] == 2 and json.load(open(f"{path}.manifest.json"))["source"] == "test"
        back = {r["sample_token"]: r for r in tables.read_table(spark, path, "t1_signals").collect()}
        assert back["a"]["ent"] == pytest.approx(0.123457, abs=1e-6) and back["b"]["n_det"] == 0
    rows = tables.read_rows(spark, f"{tmp_path}/t.parquet", tables.CONTRACTS["t1_signals"].schema, "a", ["sample_token", "ent"])
    assert rows.count() == 1 and "EqualTo(sample_token,a)" in rows._jdf.queryExecution().executedPlan().toString()
    assert tables.read_rows(spark, f"{tmp_path}/none.parquet", tables.CONTRACTS["t1_signals"].schema, ["a"]).count() == 0
    open(tmp_path / "tokens.txt", "w").write("b\n\na\nb\n")
    assert [(r["sample_token"], r["rank"]) for r in tables.ranked_tokens(spark, f"{tmp_path}/tokens.txt", df).orderBy("rank").collect()] == [("b", 0), ("a", 2)]
    open(tmp_path / "tokens.txt", "a").write("zzz\n")
    with pytest.raises(ContractError):
        tables.ranked_tokens(spark, f"{tmp_path}/tokens.txt", df)
    with pytest.raises(ContractError):
        tables.aligned(df.limit(1), df)
    assert tables.signature(df, ["sample_token", "ent"]) == tables.signature(df.orderBy(F.desc("ent")), ["sample_token", "ent"]) != tables.signature(df.limit(1), ["sample_token", "ent"])
    assert tables.finite({"a": [float("nan"), 1.0]}) == {"a": [None, 1.0]}
    import pyarrow as pa

    with pa.OSFile(f"{tmp_path}/x.feather", "wb") as f, pa.ipc.new_file(f, (t := pa.table({"a": [1, 2], "b": ["x", "y"]})).schema) as w:
        w.write_table(t)
    assert tables.arrow_files(spark, str(tmp_path), "a long, b string").filter("b = 'y'").first()["a"] == 2


def test_joins(spark):
    a = spark.createDataFrame([("k", 1), ("l", 2)], "k string, x int")
    with pytest.raises(ContractError):
        joins.one_to_one(a, a.union(a).withColumnRenamed("x", "y"), ["k"])
    with pytest.raises(ContractError):
        joins.many_to_one(a, a.limit(1).withColumnRenamed("x", "y"), ["k"], complete=True)
    assert joins.left_with_zero(a, a.filter("k = 'k'").withColumnRenamed("x", "y"), ["k"]).filter("y = 0").count() == 1
    with pytest.raises(ContractError):
        joins.require_subset(a, a.limit(1), "k")
    with pytest.raises(ContractError):
        splits.check_disjoint(a, a.limit(1), "k")
    with pytest.raises(ContractError):
        splits.check_one_scene(spark.createDataFrame([("i", "a"), ("i", "b")], "i string, s string"), "i", "s")
    with pytest.raises(ContractError):
        splits.independent(["x"], ["x", "y"])
    assert splits.plan_parts([("a", 4), ("b", 5), ("c", 9), ("d", 20), ("e", 1)], 10) == [["a", "b"], ["c"], ["d"], ["e"]]
    plan = splits.plan_splits([f"s{k}" for k in range(40)], 0, 0.05, 10, {"s3": "T"})
    assert sorted(pd.Series(plan).value_counts().items()) == [("P", 27), ("S", 2), ("T", 1), ("V", 10)]


def test_freeze(tmp_path):
    f = splits.Freeze(str(tmp_path))
    with pytest.raises(ContractError):
        f.freeze("split", b"x")
    f.freeze("prereg", b"a")
    f.freeze("split", b"b")
    with pytest.raises(FileExistsError):
        f.freeze("split", b"c")
    f.check("split", b"b")
    with pytest.raises(ContractError):
        f.check("split", b"other")


def test_encoders(spark):
    enc = encoders.CachedEncoder(encoders.HashEncoder(8), most=2)
    assert enc.encode(["a"]) is enc.encode(["a"])
    for q in ("b", "c"):
        enc.encode([q])
    assert len(enc.kept) == 2
    with pytest.raises(ValueError):
        enc.encode([])
    df = spark.createDataFrame([("s", "c", f"p{k}") for k in range(5)], "sample_token string, cam string, path string")

    def fussy(paths):
        if len(paths) > 2:
            raise MemoryError
        return np.stack([encoders.seeded_vector(p, 4) for p in paths])

    assert encoders.embed_images(df, ["sample_token", "cam"], "path", fussy).count() == 5
    a, b = encoders.detect(df, ["sample_token", "cam"], "path").count(), encoders.detect(df, ["sample_token", "cam"], "path").count()
    assert a == b
    black, flat = np.zeros((8, 8), np.uint8), np.full((8, 8), 255, np.uint8)
    assert encoders.image_features(black)["veil"] == 0 and encoders.image_features(black)["sharp_ratio"] == 0
    assert encoders.image_features(flat)["blob_count"] == 1 and encoders.image_features(flat)["sat_frac"] == 1


def test_image_features_by_hand():
    """13 features at 448 x 252: a white square on grey, areas, tiles and a step edge worked out by hand."""
    image = np.full((252, 448), 100, np.uint8)
    image[10:20, 10:20] = 255
    image[100, 100] = 255  # dilated to 9 pixels: too small for a blob
    f = encoders.image_features(image)
    assert len(f) == 13 and f["blob_count"] == 1 and f["blob_max_frac"] == 144 / image.size and f["sat_frac"] == 101 / image.size
    assert f["v_p5"] == f["v_p95"] == 100 and f["veil"] == 1.0 and f["luma_mean"] == pytest.approx((100 * (image.size - 101) + 255 * 101) / image.size)
    assert f["tile_range"] == pytest.approx(155 * 100 / (63 * 112))
    step = np.zeros((252, 448), np.uint8)
    step[:, 224:] = 80
    f = encoders.image_features(step)
    lap = np.zeros(448)
    lap[223], lap[224] = 80, -80
    assert f["lap_var_raw"] == pytest.approx(lap.var()) and f["noise_sigma"] == pytest.approx(0.0) and f["sharp_ratio"] == pytest.approx(f["lap_var_dn"] / 1e-6)
    assert f["veil"] == 0.0 and f["tile_range"] == 80
    rgb = np.zeros((504, 896, 3), np.uint8)
    rgb[:, :, 0] = 200
    f = encoders.image_features(rgb)
    assert f["v_mean"] == 200 and f["luma_mean"] == 60 and f["lap_var_raw"] == 0


def test_a_failed_publication_leaves_the_former_table(spark, tmp_path, monkeypatch):
    from roadsift.sources import tables

    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(f"{path}.tmp-1")
    tables._publish(spark, f"{path}.tmp-1", path, {})
    with pytest.raises(Exception):  # noqa: B017
        tables._publish(spark, f"{path}.tmp-missing", path, {})
    assert spark.read.parquet(path).count() == 3
    spark.range(5).write.parquet(f"{path}.tmp-2")
    tables._publish(spark, f"{path}.tmp-2", path, {})
    assert spark.read.parquet(path).count() == 5 and not list(tmp_path.glob("t.old-*"))

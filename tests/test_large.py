"""Operators on tables that were too large for an earlier form of them."""

import numpy as np
from pyspark.sql import functions as F

from roadsift.functions import ranks
from roadsift.operators import projection
from roadsift.operators import similarity as sim
from roadsift.operators import splits as sp


def test_closure_has_no_limit_of_rows(spark):
    n = 300_000
    frames = spark.range(n).select(F.col("id").alias("token"), F.when(F.col("id") % 100 > 0, F.col("id") - 1).alias("prev"), F.floor(F.col("id") / 100).alias("scene_token"))
    found = sp.closure_depth(spark, frames, 3)
    assert {r["depth"]: r["count"] for r in found.groupBy("depth").count().collect()} == {k: n - k * n // 100 for k in range(4)}
    assert found.filter("token - ancestor <> depth").isEmpty()


def test_closure_stays_in_its_scene_and_ends(spark):
    rows = [("a", None, 1), ("b", "a", 1), ("c", "b", 2), ("d", "c", 2), ("x", "x", 3)]
    found = sp.closure_depth(spark, spark.createDataFrame(rows, "token string, prev string, scene_token int"), 2)
    assert sorted(map(tuple, found.collect())) == [("a", "a", 0), ("b", "a", 1), ("b", "b", 0), ("c", "c", 0), ("d", "c", 1), ("d", "d", 0), ("x", "x", 0), ("x", "x", 1), ("x", "x", 2)]
    assert found.schema["depth"].dataType.simpleString() == "int"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cameras(spark, names=("CAM_FRONT",), n=1):
    """Cameras that look along +x."""
    rows = spark.range(n).select(F.col("id").alias("sample_token"), F.explode(F.array(*[F.lit(x) for x in names])).alias("cam"))
    fixed = {"ego_q": (1, 0, 0, 0), "ego_t": (0, 0, 0), "translation": (0, 0, 0), "rotation": (0.5, -0.5, 0.5, -0.5), "intrinsic": (1000, 0, 800, 0, 1000, 450, 0, 0, 1)}
    return rows.select("*", *[F.array(*[F.lit(float(x)) for x in v]).alias(k) for k, v in fixed.items()])


def test_cameras_of_frames_are_not_broadcast(spark):
    ids, box = spark.range(3).withColumnRenamed("id", "sample_token"), {"translation": (10, 0, 0), "size": (2, 4, 2), "rotation": (1, 0, 0, 0)}
    boxes = ids.select("sample_token", F.lit("a").alias("ann_token"), F.lit("car").alias("category"), *[F.array(*[F.lit(float(x)) for x in v]).alias(k) for k, v in box.items()], F.lit("4").alias("visibility"), F.lit(1).alias("num_lidar_pts"))
    objects = ids.select("sample_token", F.lit("o").alias("object_id"), *[F.lit(float(x)).alias(c) for c, x in {"cx": 10, "cy": 0, "cz": 0, "l": 4, "w": 2, "h": 2, "yaw": 0}.items()])
    cams = cameras(spark, n=3)
    for out in (projection.project_boxes(boxes, cams), projection.project_objects(objects, cams), projection.boxes_in_ego(boxes, cams)):
        assert "Broadcast" not in plan(out) and out.count() == 3


def test_a_box_with_a_missing_number_is_not_seen(spark):
    rows = [(0, "whole", 10.0, 0.0), (0, "null", None, 0.0), (0, "behind", -10.0, 0.0), (0, "aside", 3.0, 40.0)]
    objects = spark.createDataFrame(rows, "sample_token long, object_id string, cx double, cy double").select("*", *[F.lit(float(x)).alias(c) for c, x in {"cz": 0, "l": 4, "w": 2, "h": 2, "yaw": 0}.items()])
    seen = projection.project_objects(objects, cameras(spark, ("CAM_BACK", "CAM_FRONT"))).collect()
    assert [(r["object_id"], r["cam"], r["x1"], r["y1"], r["x2"], r["y2"], r["visible_frac"]) for r in seen] == [("whole", "CAM_FRONT", 675.0, 325.0, 925.0, 575.0, 1.0)]


def test_tiles_of_distances_are_bounded():
    for n, width in ((10_000, 131_072), (8_192, 8_192), (5, 3 * sim.CELLS), (7, 0)):
        parts = [range(n)[at] for at in sim._tiles(n, width)]
        assert [i for p in parts for i in p] == list(range(n)) and all(len(p) == 1 or len(p) * width <= sim.CELLS for p in parts)


def test_neighbours_and_close_pairs_over_several_tiles(spark):
    v = np.random.default_rng(1).normal(size=(2_200, 3)).round(1)  # more than one tile; some vectors are equal
    scene = [None if k % 5 == 4 else f"s{k % 5}" for k in range(len(v))]  # a missing scene is one of its own
    df = spark.createDataFrame([(k, scene[k], k, [float(x) for x in row]) for k, row in enumerate(v)], "id long, scene string, idx int, v array<double>").coalesce(1)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    other = np.where(np.arange(len(v))[:, None] % 5 == np.arange(len(v))[None] % 5, np.inf, d)
    for broadcast in (0, sim.BROADCAST_BYTES):
        got = {r["id"]: r["near"] for r in sim.knn_distances(df, df, "id", "v", 3, "l2", "scene", broadcast_bytes=broadcast).collect()}
        assert np.allclose([got[k] for k in range(len(v))], np.sort(other, axis=1)[:, :3], atol=1e-6)
    close = int((np.triu(v @ v.T, 1) > 2.005).sum())
    row = sim.pair_redundancy(df, "id", "v", 2.005).first()
    assert (row["n"], row["close"]) == (len(v), close)
    assert sim._count_close(sim.vector_classes(df, "id", "v"), 2.005, 2_200) <= close


def test_row_numbers_over_several_ranges(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7 % 10).alias("v"))
    order = [F.desc("v"), F.col("id")]
    got = [r["id"] for r in ranks.with_row_number(df, order, "n", rows=90).orderBy("n").collect()]
    assert got == sorted(range(1000), key=lambda i: (-(i * 7 % 10), i))
    numbers = ranks.with_row_number(df, order, "n", rows=90)
    assert sorted(r["n"] for r in numbers.collect()) == list(range(1, 1001))
    assert ranks.with_row_number(df.filter("id < 0"), order, "n").isEmpty()


def test_ranks_in_groups_over_several_ranges(spark):
    value = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 13 == 0, float("nan")).otherwise((F.col("id") * 37 % 211).cast("double"))
    group = F.when(F.col("id") % 3 == 1, "a").when(F.col("id") % 3 == 2, "b")  # and a missing one
    df = spark.range(900).select("id", value.alias("v"), group.alias("g")).unionByName(spark.sql("select id + 1000 as id, 5D as v, 'constant' as g from range(4)"))
    for constant in (False, True):
        want = {r["id"]: r["r"] for r in df.select("id", ranks.pct_rank(F.col("v"), None, ["g"], constant).alias("r")).collect()}
        got = ranks.with_group_pct_rank(df, "v", ["g"], "r", constant, rows=50)
        assert got.columns == ["id", "v", "g", "r"] and {r["id"]: r["r"] for r in got.collect()} == want and got.count() == len(want)

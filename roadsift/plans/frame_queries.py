"""Queries of frame-level operators over the stand-in tables: flags, closures, clouds, poses, evaluation panels and read-side views, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.ranks import bround6
from ..functions.scalars import bin_right, cell_key, json_probs, lookup, parse_size, starts_with_any
from ..operators import evaluation as ev
from ..operators import labels as lab
from ..operators import pointcloud as pcl
from ..operators import splits as sp
from ..operators.joins import one_to_one
from . import views
from .frames import FRAMES_SQL, OBJECTS_SQL, frames, objects, table
from .score_queries import BOXES_SQL, ORDERS_SQL, boxes, order_frames

_CATEGORIES = {"A": "vehicle.bicycle", "N": "human.pedestrian.adult", "R": "vehicle.car"}


def camera_rare_flags(spark, d):
    """Six flags of rare frames from scene text and boxes, groups gated by their share of the pool."""
    f = order_frames(spark, d).select("sample_token", F.when(F.col("scene_desc").startswith("1"), F.lit("Night drive")).when(F.col("scene_token") % 25 == 0, F.lit("rain, wet road")).otherwise(F.lit("day")).alias("scene_desc"))
    b = objects(spark, d).select(F.col("l_orderkey").alias("sample_token"), lookup(F.col("l_returnflag"), _CATEGORIES).alias("category"), (F.col("l_partkey") % 40 + 1).cast("string").alias("visibility"), F.floor(F.col("l_discount") * 100 + 1e-9).cast("int").alias("num_lidar_pts"))
    return lab.camera_flags(f, b, crowd=3, most_freq=0.30)


FLAGS_SQL = f"""
WITH {OBJECTS_SQL}, {ORDERS_SQL},
p AS (SELECT l_orderkey AS sample_token, bool_or(l_returnflag = 'A') AS b, count(*) FILTER (l_returnflag = 'N') >= 3 AS c1, bool_or(l_partkey % 40 = 0) AS c2, bool_or(floor(l_discount * 100 + 1e-9) BETWEEN 1 AND 5) AS c3 FROM o GROUP BY 1),
x AS (SELECT fr.sample_token, scene_desc[1] = '1' AS a1, scene_desc[1] <> '1' AND scene_token % 25 = 0 AS a2, coalesce(b, false) AS b, coalesce(c1, false) AS c1, coalesce(c2, false) AS c2, coalesce(c3, false) AS c3 FROM fr LEFT JOIN p USING (sample_token)),
g AS (SELECT avg(a1::INT) <= 0.3::DOUBLE AS ga1, avg(a2::INT) <= 0.3::DOUBLE AS ga2, avg(b::INT) <= 0.3::DOUBLE AS gb, avg(c1::INT) <= 0.3::DOUBLE AS gc1, avg(c2::INT) <= 0.3::DOUBLE AS gc2, avg(c3::INT) <= 0.3::DOUBLE AS gc3 FROM x)
SELECT sample_token, (a1 AND ga1) OR (a2 AND ga2) OR (b AND gb) OR (c1 AND gc1) OR (c2 AND gc2) OR (c3 AND gc3) AS is_rare, a1 AS "A_night", a2 AS "A_rain", b AS "B_rare_class", c1 AS "C_crowd", c2 AS "C_low_vis", c3 AS "C_far" FROM x, g
"""


def preprocessed_points(spark, d):
    """Points without near returns, cropped, the first of every voxel."""
    p = objects(spark, d).select(F.col("l_orderkey").alias("f"), F.col("l_linenumber").alias("idx"), (F.col("l_quantity") - 25).alias("x"), (F.col("l_discount") * 100 - 5).alias("y"), F.col("l_tax").alias("z"), (F.col("l_partkey") % 256).cast("double").alias("intensity"))
    out = pcl.preprocess(p, "f", "idx", pcl.CloudConfig(close=4.0, crop=20.0, voxel=6.0))
    return out.select("f", "idx", "x", bround6(F.col("y")).alias("y"), "intensity")


PRE_SQL = f"""
WITH {OBJECTS_SQL}, p AS (SELECT l_orderkey AS f, l_linenumber AS idx, l_quantity - 25 AS x, l_discount * 100 - 5 AS y, l_tax AS z, (l_partkey % 256)::DOUBLE AS intensity FROM o)
SELECT f, idx, x, round_even(y, 6) AS y, intensity FROM p WHERE NOT (abs(x) < 4 AND abs(y) < 4) AND abs(x) <= 20 AND abs(y) <= 20
QUALIFY row_number() OVER (PARTITION BY f, floor(x / 6), floor(y / 6), floor(z / 6) ORDER BY idx) = 1
"""


def sensor_blocks(spark, d):
    """Share of near points above ground and the spread of intensity of every sweep."""
    p = objects(spark, d).select(F.col("l_orderkey").alias("f"), (F.col("l_quantity") - 25).alias("x"), (F.col("l_discount") * 100 - 5).alias("y"), (F.col("l_partkey") % 256).cast("double").alias("intensity"), (F.col("l_tax") > 0.015).alias("above"))
    return pcl.sensor_block(p, "f", 12.0, "above").select("f", *[bround6(F.col("sensor")[k]).alias(n) for k, n in enumerate(("near", "mean_intensity", "std_intensity"))])


SENSOR_SQL = f"""
WITH {OBJECTS_SQL} SELECT l_orderkey AS f, round_even(count(*) FILTER ((l_quantity - 25) ** 2 + (l_discount * 100 - 5) ** 2 < 144 AND l_tax > 0.015::DOUBLE) / count(*), 6) AS near,
       round_even(avg(l_partkey % 256) / 255, 6) AS mean_intensity, round_even(stddev_pop(l_partkey % 256) / 255, 6) AS std_intensity FROM o GROUP BY 1
"""


def sweep_closure(spark, d):
    """Predecessors of every frame up to three steps back within its scene."""
    f = frames(spark, d)
    w = Window.partitionBy("user_id").orderBy("frame_idx")
    linked = f.select(F.col("event_id").alias("token"), F.lag("event_id").over(w).alias("prev"), F.col("user_id").alias("scene_token"))
    return sp.closure_depth(spark, linked, 3).select("token", "ancestor", "depth")


CLOSURE_SQL = f"WITH {FRAMES_SQL}, d AS (SELECT unnest(range(0, 4)) AS depth) SELECT a.event_id AS token, b.event_id AS ancestor, depth::INTEGER AS depth FROM f a, d JOIN f b ON b.user_id = a.user_id AND b.frame_idx = a.frame_idx - depth"


def camera_points(spark, d):
    """Objects of the world in the vehicle's and then the sensor's frame, and back again."""
    e_q = F.array(F.cos(F.col("a") / 2), F.lit(0.0), F.lit(0.0), F.sin(F.col("a") / 2))
    s_q, s_t = F.array(*[F.lit(x) for x in (0.8, 0.6, 0.0, 0.0)]), F.array(F.lit(1.5), F.lit(0.0), F.lit(1.8))
    o = boxes(spark, d).select("sample_token", "object_id", F.array("cx", "cy", "h").alias("p"), (F.col("pts") * 0.3).alias("a"), F.array(F.col("dist_m"), F.lit(2.0), F.lit(0.5)).alias("e_t"))
    o = o.withColumn("e", geo.to_child(F.col("p"), e_q, F.col("e_t"))).withColumn("s", geo.to_child(F.col("e"), s_q, s_t))
    back = geo.to_parent(geo.to_parent(F.col("s"), s_q, s_t), e_q, F.col("e_t"))
    o = o.withColumn("back", back)
    return o.select("sample_token", "object_id", *[bround6(F.col("s")[k]).alias(n) for k, n in enumerate(("sx", "sy", "sz"))], *[bround6(F.col("back")[k]).alias(n) for k, n in enumerate(("wx", "wy"))])


CAMERA_SQL = f"""
WITH {BOXES_SQL}, q AS (SELECT *, pts * 0.3::DOUBLE AS a FROM b),
e AS (SELECT *, cos(a) * (cx - dist_m) + sin(a) * (cy - 2) - 1.5 AS ex, cos(a) * (cy - 2) - sin(a) * (cx - dist_m) AS ey, h - 0.5 - 1.8 AS ez FROM q)
SELECT sample_token, object_id, round_even(ex, 6) AS sx, round_even(0.28::DOUBLE * ey + 0.96::DOUBLE * ez, 6) AS sy, round_even(0.28::DOUBLE * ez - 0.96::DOUBLE * ey, 6) AS sz, round_even(cx, 6) AS wx, round_even(cy, 6) AS wy FROM e
"""


def rater_agreement_rows(spark, d):
    """Two raters' labels of the same frames joined one to one, and cells of their objects as text."""
    f = order_frames(spark, d)
    a = f.select("sample_token", (F.col("o_totalprice") > 150000).alias("first"))
    b = f.filter("sample_token % 5 <> 0").select("sample_token", (F.col("o_orderstatus") == "F").alias("second"))
    return one_to_one(a, b, ["sample_token"]).select("sample_token", "first", "second", F.coalesce(F.col("first") == F.col("second"), F.lit(False)).alias("agree"))


RATER_SQL = f"WITH {ORDERS_SQL} SELECT sample_token, o_totalprice > 150000 AS first, CASE WHEN sample_token % 5 <> 0 THEN o_orderstatus = 'F' END AS second, coalesce(CASE WHEN sample_token % 5 <> 0 THEN (o_totalprice > 150000) = (o_orderstatus = 'F') END, false) AS agree FROM fr"


def object_cells(spark, d):
    """Cell text, group and prefix test of every object, its probabilities as JSON and a size with its unit in bytes."""
    cell = cell_key(F.col("cls_pred"), bin_right(F.col("dist_m"), lab.DISTANCE_BINS, clip=True), bin_right(F.col("pts"), lab.POINT_BINS, clip=True))
    unit = F.element_at(F.array(*[F.lit(u) for u in ("", "KB", " MB", "GiB")]), F.col("pts") % 4 + 1)
    probs = json_probs(["near", "far"], [1 - F.col("dist_m") / 64, F.col("dist_m") / 64])
    return boxes(spark, d).select(
        "sample_token", "object_id", cell.alias("cell"), lookup(F.col("cls_pred"), {"pedestrian": "vru", "bicycle": "vru"}, "none").alias("grp"), starts_with_any(F.col("cls_pred"), ["ped", "oth"]).alias("walks"),
        F.get_json_object(probs, "$.far").cast("double").alias("far"), parse_size(F.concat((F.col("pts") + 1).cast("string"), F.lit(".5"), unit)).alias("bytes"),
    )


CELLS_SQL = f"""
WITH {BOXES_SQL}
SELECT sample_token, object_id, cls_pred || '|d' || CASE WHEN dist_m < 20 THEN 0 WHEN dist_m < 40 THEN 1 ELSE 2 END || '|p' || CASE WHEN pts < 5 THEN 0 WHEN pts < 20 THEN 1 ELSE 2 END AS cell, CASE WHEN cls_pred = 'other' THEN 'none' ELSE 'vru' END AS grp,
       cls_pred <> 'bicycle' AS walks, round_even(dist_m / 64, 6) AS far, floor((pts + 1.5::DOUBLE) * 1024 ** (pts % 4))::BIGINT AS bytes FROM b
"""


def _runs(spark, d):
    f = order_frames(spark, d).withColumns({"rare": F.col("o_orderstatus") == "P", "k": F.col("scene_token") % 40})
    return f, {"price": F.col("o_totalprice") > 200000, "recent": F.col("t") > 852076800000000}


def paired_precision_ci(spark, d):
    """Interval of the difference of two selections' precision over resampled scenes."""
    f, runs = _runs(spark, d)
    stats = None
    for name, chosen in runs.items():
        own = f.groupBy("k").agg(F.count_if(chosen & F.col("rare")).alias("hit"), F.count_if(chosen).alias("n")).withColumn("method", F.lit(name))
        stats = own if stats is None else stats.unionByName(own)
    values = ev.bootstrap_ratio(stats, ev.hash_draws(spark, f, "k", 100, 7), "method", "k", "hit", "n")
    return ev.paired_ci(values, "method", "price", "recent").select(*[bround6(F.col(c)).alias(c) for c in ("mean", "low", "high")])


_DRAWS = """dr AS (SELECT b, ('0x' || substr(md5('7|' || b || '|' || j), 1, 12))::BIGINT % (SELECT count(DISTINCT scene_token % 40) FROM fr) AS i FROM (SELECT unnest(range(0, 100)) AS b) bb, (SELECT unnest(range(0, (SELECT count(DISTINCT scene_token % 40) FROM fr))) AS j) jj)"""
PAIRED_SQL = f"""
WITH {ORDERS_SQL}, {_DRAWS},
s AS (SELECT scene_token % 40 AS k, row_number() OVER (ORDER BY scene_token % 40) - 1 AS i, count(*) FILTER (o_totalprice > 200000 AND o_orderstatus = 'P') AS ha, count(*) FILTER (o_totalprice > 200000) AS na, count(*) FILTER (t > 852076800000000 AND o_orderstatus = 'P') AS hb, count(*) FILTER (t > 852076800000000) AS nb FROM fr GROUP BY 1),
v AS (SELECT b, sum(ha) / greatest(sum(na), 1) - sum(hb) / greatest(sum(nb), 1) AS x FROM dr JOIN s USING (i) GROUP BY 1)
SELECT round_even(avg(x), 6) AS mean, round_even(quantile_cont(x, 0.025), 6) AS low, round_even(quantile_cont(x, 0.975), 6) AS high FROM v
"""


def detectable_effect(spark, d):
    """Least effect that a pool can show, by the spread of frame differences."""
    f = order_frames(spark, d).select(((F.col("o_totalprice") - 150000) / 100000).alias("delta"))
    return ev.power(f, "delta", 300, 1200).select(bround6(F.col("mde")).alias("mde"))


EFFECT_SQL = f"WITH {ORDERS_SQL} SELECT round_even(2.8::DOUBLE * stddev_samp((o_totalprice - 150000) / 100000) * 0.5, 6) AS mde FROM fr"


def selection_panel(spark, d):
    """Recall, coverage of rare cells and normalised yield of a selection, against all and against none."""
    f, runs = _runs(spark, d)
    chosen = f.filter(runs["price"])
    o = boxes(spark, d)
    cells = o.groupBy("sample_token").agg(F.collect_set(F.concat_ws("|", "cls_pred", F.floor(F.col("dist_m") / 10).cast("string"), "pts")).alias("cells"))
    metrics = ev.selection_metrics(f, chosen, "sample_token", "rare", "k")
    iy = ev.instance_yield(o.select("sample_token", "track_id"), chosen, "sample_token", "track_id", 100).select("iy", "targets")
    out = metrics.crossJoin(ev.cell_coverage(cells, chosen, "sample_token", "cells").withColumnRenamed("coverage", "cell_coverage")).crossJoin(iy)  # one row each
    return out.select("n", "n_sel", "hits", *[bround6(F.col(c)).alias(c) for c in ("recall", "uplift", "scene_recall", "cell_coverage")], bround6(ev.normalised_yield(F.col("iy"), F.lit(0.5), F.col("targets") / 100)).alias("niy"))


PANEL_SQL = f"""
WITH {BOXES_SQL}, {ORDERS_SQL}, c AS (SELECT sample_token, scene_token % 40 AS k, o_totalprice > 200000 AS s, o_orderstatus = 'P' AS r FROM fr),
m AS (SELECT count(*) AS n, count(*) FILTER (s) AS n_sel, count(*) FILTER (s AND r) AS hits, count(*) FILTER (r) AS n_rare, count(DISTINCT k) FILTER (r) AS rs, count(DISTINCT k) FILTER (r AND s) AS hs FROM c),
x AS (SELECT count(DISTINCT cls_pred || '|' || floor(dist_m / 10)::BIGINT || '|' || pts) FILTER (s) / count(DISTINCT cls_pred || '|' || floor(dist_m / 10)::BIGINT || '|' || pts) AS cc, count(DISTINCT track_id) FILTER (s) / 100 AS iy, count(DISTINCT track_id) / 100 AS top FROM b JOIN c USING (sample_token))
SELECT n, n_sel, hits, round_even(hits / greatest(n_rare, 1), 6) AS recall, round_even(hits / greatest(n_rare, 1) / (n_sel / n), 6) AS uplift, round_even(hs / greatest(rs, 1), 6) AS scene_recall, round_even(cc, 6) AS cell_coverage,
       CASE WHEN top - 0.5 > 0 THEN round_even((iy - 0.5::DOUBLE) / (top - 0.5::DOUBLE), 6) END AS niy FROM m, x
"""


def review_page(spark, d):
    """A page of images to be reviewed."""
    o = objects(spark, d).select(F.col("l_orderkey").alias("sample_token"), F.concat(F.lit("CAM_"), F.col("l_linenumber").cast("string")).alias("cam"), (F.col("l_linestatus") == "O").alias("review"))
    return views.review_queue(o, 40, 60).select("sample_token", "cam")


REVIEW_SQL = f"WITH {OBJECTS_SQL} SELECT l_orderkey AS sample_token, 'CAM_' || l_linenumber AS cam FROM o WHERE l_linestatus = 'O' ORDER BY 1, 2 LIMIT 60 OFFSET 40"


def example_frames(spark, d):
    """Frames of one selection that a rival lacks, those with most struggling instances first."""
    f, runs = _runs(spark, d)
    s = boxes(spark, d).select("sample_token", F.col("track_id").alias("instance_token"), (F.col("pts") < 8).alias("struggle"))
    return views.examples(f.filter(runs["price"]).select("sample_token"), f.filter(runs["recent"]), s, 12).select("sample_token", "n_struggle")


EXAMPLE_SQL = f"""
WITH {BOXES_SQL}, {ORDERS_SQL}, n AS (SELECT sample_token, count(DISTINCT track_id) AS n FROM b WHERE pts < 8 GROUP BY 1)
SELECT sample_token, coalesce(n, 0) AS n_struggle FROM fr LEFT JOIN n USING (sample_token) WHERE o_totalprice > 200000 AND NOT t > 852076800000000 ORDER BY 2 DESC, 1 LIMIT 12
"""


def sub_dataset_rows(spark, d):
    """Samples and annotations reachable from chosen scenes; links out of the subset become empty."""
    o = table(spark, d, "orders").filter("o_orderkey % 7 <> 3").select(F.col("o_orderkey").cast("string").alias("token"), F.col("o_custkey").cast("string").alias("scene_token"), F.col("o_orderkey").alias("at"))
    sample = sp.linked(o, ["scene_token"], ["at"]).drop("at")
    tables = {
        "scene": table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("token"), F.col("c_name").alias("name"), "c_mktsegment"), "sample": sample,
        "sample_data": sample.select(F.concat(F.lit("d"), "token").alias("token"), F.col("token").alias("sample_token")),
        "sample_annotation": objects(spark, d).select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("token"), F.col("l_orderkey").cast("string").alias("sample_token")),
    }
    out = sp.sub_dataset(tables, tables["scene"].filter("c_mktsegment = 'BUILDING'"))
    counts = out["sample_annotation"].groupBy("sample_token").agg(F.count(F.lit(1)).alias("n_boxes"))
    return out["sample"].join(counts, out["sample"].token == counts.sample_token, "left").select("token", "scene_token", "prev", "next", F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"))


SUB_SQL = f"""
WITH {OBJECTS_SQL}, s AS (SELECT o_orderkey AS k, o_custkey, lag(o_orderkey) OVER w AS p, lead(o_orderkey) OVER w AS n FROM orders WHERE o_orderkey % 7 <> 3 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), c AS (SELECT l_orderkey AS k, count(*) AS n_boxes FROM o GROUP BY 1)
SELECT s.k::VARCHAR AS token, o_custkey::VARCHAR AS scene_token, coalesce(p::VARCHAR, '') AS prev, coalesce(n::VARCHAR, '') AS next, coalesce(n_boxes, 0) AS n_boxes FROM s JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING' LEFT JOIN c USING (k)
"""

QUERIES = {
    "camera_rare_flags": (camera_rare_flags, FLAGS_SQL),
    "preprocessed_points": (preprocessed_points, PRE_SQL),
    "sensor_blocks": (sensor_blocks, SENSOR_SQL),
    "sweep_closure": (sweep_closure, CLOSURE_SQL),
    "camera_points": (camera_points, CAMERA_SQL),
    "rater_agreement_rows": (rater_agreement_rows, RATER_SQL),
    "object_cells": (object_cells, CELLS_SQL),
    "paired_precision_ci": (paired_precision_ci, PAIRED_SQL),
    "detectable_effect": (detectable_effect, EFFECT_SQL),
    "selection_panel": (selection_panel, PANEL_SQL),
    "review_page": (review_page, REVIEW_SQL),
    "example_frames": (example_frames, EXAMPLE_SQL),
    "sub_dataset_rows": (sub_dataset_rows, SUB_SQL),
}

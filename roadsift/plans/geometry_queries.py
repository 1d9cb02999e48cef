"""Queries of geometry and spatial joins: suppliers and customers as points, lineitems as boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.ranks import bround6
from ..operators import evaluation as ev
from ..operators.joins import interpolate_pose, within_radius
from .frames import FRAMES_SQL, OBJECTS_SQL, frames, objects, table


def _angle():
    return F.col("l_linenumber") * 0.3 + F.col("l_tax") * 10


def quat_yaw_rotate(spark, d):
    """Points turned by a quaternion about z, and the yaw read back."""
    a = _angle()
    q = F.array(F.cos(a / 2), F.lit(0.0), F.lit(0.0), F.sin(a / 2))
    p = F.array(F.col("l_quantity"), F.col("l_discount") * 100, F.lit(1.0))
    o = objects(spark, d).withColumns({"q": q, "p": p}).withColumn("r", g.rotate(g.rotation_matrix(F.col("q")), F.col("p")))
    return o.select("l_orderkey", "l_linenumber", *[bround6(F.col("r")[k]).alias(n) for k, n in enumerate("xyz")], bround6(g.yaw(F.col("q"))).alias("yaw"))


QUAT_SQL = f"""
WITH {OBJECTS_SQL}, a AS (SELECT *, l_linenumber * 0.3::DOUBLE + l_tax * 10 AS a FROM o)
SELECT l_orderkey, l_linenumber, round_even(cos(a) * l_quantity - sin(a) * l_discount * 100, 6) AS x, round_even(sin(a) * l_quantity + cos(a) * l_discount * 100, 6) AS y, round_even(1.0::DOUBLE, 6) AS z,
       round_even(atan2(sin(a), cos(a)), 6) AS yaw FROM a
"""


def _boxes(spark, d):
    o = objects(spark, d)
    return o.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 1.0).alias("x1"), (F.col("l_discount") * 200).alias("y1"), (F.col("l_quantity") + 12).alias("x2"), (F.col("l_discount") * 200 + 6).alias("y2"), "l_extendedprice", "l_returnflag")


_BOX_SQL = f"{OBJECTS_SQL}, b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x1, l_discount * 200 AS y1, l_quantity + 12 AS x2, l_discount * 200 + 6 AS y2, l_extendedprice, l_returnflag FROM o)"
_IOU_SQL = "greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"


def iou_match(spark, d):
    """Best detection score (not exclusive) of every object of the frame whose boxes overlap by 0.1."""
    b = _boxes(spark, d)
    gt = b.filter("l_returnflag = 'N'").select("l_orderkey", F.col("l_linenumber").alias("ann_token"), *[F.col(c).alias(f"g{c}") for c in ("x1", "y1", "x2", "y2")])
    det = b.filter("l_returnflag <> 'N'").select("l_orderkey", "x1", "y1", "x2", "y2", F.col("l_extendedprice").alias("score"))
    overlap = g.iou([F.col(f"g{c}") for c in ("x1", "y1", "x2", "y2")], [F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return ev.best_score_match(gt, det, ["l_orderkey"], overlap, 0.1).select("l_orderkey", "ann_token", "best_score")


IOU_SQL = f"""
WITH {_BOX_SQL},
m AS (SELECT a.l_orderkey, a.l_linenumber, max(b.l_extendedprice) AS s FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = 'N' AND b.l_returnflag <> 'N' WHERE {_IOU_SQL} / greatest(12 * 6 * 2 - {_IOU_SQL}, 1e-9) >= 0.1 GROUP BY 1, 2)
SELECT b.l_orderkey, b.l_linenumber AS ann_token, coalesce(s, 0.0) AS best_score FROM b LEFT JOIN m USING (l_orderkey, l_linenumber) WHERE l_returnflag = 'N'
"""


def radius_semi_join(spark, d):
    """Customers with a supplier of the same nation within the closed radius in a made-up plane."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 97 * 1.0).alias("x"), (F.col("c_custkey") % 89 * 1.0).alias("y"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n"), (F.col("s_suppkey") % 83 * 1.0).alias("x"), (F.col("s_suppkey") % 79 * 1.0).alias("y"))
    return within_radius(s, c, ["n"], 15.0).select("c_custkey")


RADIUS_SQL = """
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND (s_suppkey % 83 - c_custkey % 97) ** 2 + (s_suppkey % 79 - c_custkey % 89) ** 2 <= 225)
"""


def box_corners_extent(spark, d):
    """Extent of the eight corners of rotated boxes."""
    a = _angle()
    o = objects(spark, d).select("l_orderkey", "l_linenumber", F.array(F.cos(a / 2), F.lit(0.0), F.lit(0.0), F.sin(a / 2)).alias("q"), F.array(F.col("l_quantity"), F.lit(0.0), F.lit(0.0)).alias("c"), F.array(F.lit(2.0), F.col("l_discount") * 100 + 1, F.lit(1.5)).alias("s"))
    o = o.withColumn("k", g.box_corners(F.col("c"), F.col("s"), F.col("q")))
    ext = lambda i: F.array_max(F.transform("k", lambda p: p[i])) - F.array_min(F.transform("k", lambda p: p[i]))
    return o.select("l_orderkey", "l_linenumber", *[bround6(ext(i)).alias(n) for i, n in enumerate(("dx", "dy", "dz"))])


CORNERS_SQL = f"""
WITH {OBJECTS_SQL}, a AS (SELECT l_orderkey, l_linenumber, l_linenumber * 0.3::DOUBLE + l_tax * 10 AS a, l_discount * 100 + 1 AS l FROM o)
SELECT l_orderkey, l_linenumber, round_even(abs(cos(a)) * l + abs(sin(a)) * 2, 6) AS dx, round_even(abs(sin(a)) * l + abs(cos(a)) * 2, 6) AS dy, round_even(1.5::DOUBLE, 6) AS dz FROM a
"""


def principal_yaw(spark, d):
    o = objects(spark, d).groupBy("l_suppkey").agg(F.var_pop("l_quantity").alias("vx"), F.var_pop(F.col("l_discount") * 100).alias("vy"), F.covar_pop("l_quantity", F.col("l_discount") * 100).alias("c"))
    return o.select("l_suppkey", bround6(g.principal_yaw(F.col("vx"), F.col("vy"), F.col("c"))).alias("yaw"))


def pose_interpolation(spark, d):
    """Values of a user's views read at the times of the clicks."""
    f = frames(spark, d)
    poses = f.filter("event_type = 'view'").select("user_id", F.col("t").cast("double").alias("t"), F.col("value").alias("x"))
    times = f.filter("event_type = 'click'").select("user_id", "event_id", F.col("t").cast("double").alias("t"))
    return interpolate_pose(times, poses, ["user_id"], "t", ["x"], None).select("event_id", bround6(F.col("x")).alias("x"))


POSE_SQL = f"""
WITH {FRAMES_SQL}, v AS (SELECT user_id, t::DOUBLE AS t, value FROM f WHERE event_type = 'view'), c AS (SELECT user_id, event_id, t::DOUBLE AS t FROM f WHERE event_type = 'click'),
a AS (SELECT c.*, v.t AS t0, v.value AS x0 FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.t >= v.t),
z AS (SELECT a.*, v.t AS t1, v.value AS x1 FROM a ASOF LEFT JOIN v ON a.user_id = v.user_id AND a.t <= v.t)
SELECT event_id, round_even(CASE WHEN t0 IS NULL THEN x1 WHEN t1 IS NULL OR t1 = t0 THEN x0 ELSE x0 + (t - t0) / (t1 - t0) * (x1 - x0) END, 6) AS x FROM z
"""

QUERIES = {
    "quat_yaw_rotate": (quat_yaw_rotate, QUAT_SQL),
    "iou_match": (iou_match, IOU_SQL),
    "radius_semi_join": (radius_semi_join, RADIUS_SQL),
    "box_corners_extent": (box_corners_extent, CORNERS_SQL),
    "principal_yaw": (principal_yaw, f"WITH {OBJECTS_SQL} SELECT l_suppkey, round_even(0.5 * atan2(2 * covar_pop(l_quantity, l_discount * 100), var_pop(l_quantity) - var_pop(l_discount * 100)), 6) AS yaw FROM o GROUP BY 1"),
    "pose_interpolation": (pose_interpolation, POSE_SQL),
}

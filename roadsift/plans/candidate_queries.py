"""Queries of object candidates over the stand-in tables: vehicle frame, world, merging, tracks, matching and camera boxes, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.geometry import rotation_matrix
from ..functions.ranks import bround6
from ..operators import candidates as cand
from ..operators import matching as mt
from ..operators import projection as pj
from .frames import OBJECTS_SQL, objects
from .score_queries import BOXES_SQL, ORDERS_SQL, boxes, order_frames


def _turn(angle):
    """Quaternion about z."""
    return F.array(F.cos(angle / 2), F.lit(0.0), F.lit(0.0), F.sin(angle / 2))


def _calibration(spark, d):
    """A turn and a shift for the frames that are not pending."""
    f = order_frames(spark, d).filter("o_orderstatus <> 'P'")
    return f.select("sample_token", rotation_matrix(_turn((F.col("scene_token") % 7) * 0.4)).alias("R"), F.array(F.lit(1.0), F.lit(-0.5), F.lit(2.0)).alias("t"))


_NAMES, _GROUPS = ("Pedestrian", "Cyclist", "Car"), {"Pedestrian": "pedestrian", "Cyclist": "bicycle"}


def detector_boxes(spark, d):
    """Detector boxes above the score limit, in the vehicle's frame where a calibration is known."""
    o = objects(spark, d).select(
        F.col("l_orderkey").alias("sample_token"), "l_linenumber", (F.col("l_quantity") - 25).alias("cx"), (F.col("l_discount") * 100 - 5).alias("cy"), F.lit(0.5).alias("cz"), (F.col("l_tax") * 10 + 1).alias("l"), F.lit(1.5).alias("w"), F.lit(1.2).alias("h"),
        (F.col("l_linenumber") * 0.9).alias("yaw"), (F.col("l_linenumber") - 1).alias("label"), (F.floor(F.col("l_extendedprice")) % 100 / 100).alias("score"),
    )
    out = cand.detector_candidates(o, _NAMES, _GROUPS, _calibration(spark, d), 0.3)
    return out.select("sample_token", "cls_pred", "pts", "score", *[bround6(F.col(c)).alias(c) for c in ("cx", "cy", "cz", "l", "w", "h", "yaw", "dist_m")])


DETECTOR_SQL = f"""
WITH {OBJECTS_SQL}, {ORDERS_SQL},
q AS (SELECT l_orderkey AS sample_token, l_linenumber AS n, l_quantity - 25 AS x, l_discount * 100 - 5 AS y, l_tax * 10 + 1 AS l, l_linenumber * 0.9::DOUBLE AS yaw, floor(l_extendedprice) % 100 / 100 AS score FROM o),
k AS (SELECT q.*, CASE WHEN o_orderstatus <> 'P' THEN (scene_token % 7) * 0.4::DOUBLE END AS a FROM q LEFT JOIN fr USING (sample_token) WHERE score >= 0.3::DOUBLE),
m AS (SELECT *, CASE WHEN a IS NULL THEN x ELSE cos(a) * x - sin(a) * y + 1 END AS cx, CASE WHEN a IS NULL THEN y ELSE sin(a) * x + cos(a) * y - 0.5 END AS cy FROM k)
SELECT sample_token, CASE n WHEN 2 THEN 'pedestrian' WHEN 3 THEN 'bicycle' ELSE 'other' END AS cls_pred, 0 AS pts, score, round_even(cx, 6) AS cx, round_even(cy, 6) AS cy, CASE WHEN a IS NULL THEN 0.5::DOUBLE ELSE 2.5::DOUBLE END AS cz,
       round_even(l, 6) AS l, 1.5::DOUBLE AS w, 1.2::DOUBLE AS h, round_even(CASE WHEN a IS NULL THEN yaw ELSE atan2(sin(yaw + a), cos(yaw + a)) END, 6) AS yaw, round_even(sqrt(cx * cx + cy * cy), 6) AS dist_m FROM m
"""


def world_positions(spark, d):
    """Places of candidates in the world by the vehicle's pose."""
    poses = order_frames(spark, d).select("sample_token", (F.col("scene_token") * 1.5).alias("ego_x"), F.floor(F.col("o_totalprice") / 1000).alias("ego_y"), ((F.col("sample_token") % 63) / 10).alias("ego_yaw"))
    return cand.in_world(boxes(spark, d), poses).select("sample_token", "object_id", bround6(F.col("gx")).alias("gx"), bround6(F.col("gy")).alias("gy"))


WORLD_SQL = f"""
WITH {BOXES_SQL}, {ORDERS_SQL}, p AS (SELECT sample_token, scene_token * 1.5::DOUBLE AS ex, floor(o_totalprice / 1000) AS ey, (sample_token % 63) / 10 AS a FROM fr)
SELECT sample_token, object_id, round_even(ex + cos(a) * cx - sin(a) * cy, 6) AS gx, round_even(ey + sin(a) * cx + cos(a) * cy, 6) AS gy FROM b JOIN p USING (sample_token)
"""


def _coarse(spark, d):
    """Objects on a coarse grid, so that boxes of a frame overlap and areas are exact."""
    return objects(spark, d).select(
        F.col("l_orderkey").alias("sample_token"), "l_linenumber", (F.col("l_quantity") % 8).alias("cx"), (F.floor(F.col("l_discount") * 100 + 1e-9) % 5).cast("double").alias("cy"), F.lit(0.0).alias("cz"),
        F.lit(6.0).alias("l"), (F.floor(F.col("l_tax") * 100 + 1e-9) % 3 + 2).cast("double").alias("w"), F.lit(1.5).alias("h"), F.lit(0.0).alias("yaw"), (F.col("l_partkey") % 90).cast("int").alias("pts"), F.col("l_returnflag").alias("cls_pred"), F.floor(F.col("l_extendedprice")).cast("double").alias("score"),
    )


_COARSE = f"""{OBJECTS_SQL}, g AS (
  SELECT l_orderkey AS f, l_linenumber AS n, l_quantity % 8 AS cx, floor(l_discount * 100 + 1e-9) % 5 AS cy, 6::DOUBLE AS l, floor(l_tax * 100 + 1e-9) % 3 + 2 AS w, (l_partkey % 90)::INTEGER AS pts, l_returnflag AS cls, floor(l_extendedprice) AS score FROM o)"""


def merged_candidates(spark, d):
    """Clusters (odd lines) and detector boxes (even lines) of a frame paired by greatest overlap."""
    g = _coarse(spark, d)
    even = F.col("l_linenumber") % 2 == 0
    out = mt.merge_flagged(g.withColumn("pts", F.when(even, 0).otherwise(F.col("pts"))), even, least=0.3)
    return out.select("sample_token", "cx", "cy", "l", "w", "pts", "cls_pred", "source", "missed_by_model", bround6(F.col("dist_m")).alias("dist_m"))


_BOTH = "greatest(0, least(a.cx + 3, b.cx + 3) - greatest(a.cx - 3, b.cx - 3)) * greatest(0, least(a.cy + a.w / 2, b.cy + b.w / 2) - greatest(a.cy - a.w / 2, b.cy - b.w / 2))"
MERGED_SQL = f"""
WITH RECURSIVE {_COARSE},
r AS (SELECT *, row_number() OVER (PARTITION BY f, n % 2 ORDER BY cx, cy, w, CASE WHEN n % 2 = 1 THEN pts END, cls) AS i FROM g),
pr AS (SELECT a.f, a.i, b.i AS j, {_BOTH} AS area, a.l * a.w + b.l * b.w AS total FROM r a JOIN r b ON a.f = b.f AND a.n % 2 = 1 AND b.n % 2 = 0),
li AS (SELECT f, list({{'i': i, 'j': j}} ORDER BY area / greatest(total - area, 1e-9) DESC, i, j) AS todo FROM pr WHERE area / greatest(total - area, 1e-9) >= 0.3::DOUBLE GROUP BY f),
st AS (
  SELECT f, todo[1].i AS i, todo[1].j AS j, list_filter(todo, lambda x: x.i <> todo[1].i AND x.j <> todo[1].j) AS todo FROM li
  UNION ALL SELECT f, todo[1].i, todo[1].j, list_filter(todo, lambda x: x.i <> todo[1].i AND x.j <> todo[1].j) FROM st WHERE len(todo) > 0),
u AS (
  SELECT b.f, b.cx, b.cy, b.l, b.w, a.pts, b.cls, 'merged' AS source, false AS missed FROM st JOIN r a ON a.f = st.f AND a.i = st.i AND a.n % 2 = 1 JOIN r b ON b.f = st.f AND b.i = st.j AND b.n % 2 = 0
  UNION ALL SELECT a.f, a.cx, a.cy, a.l, a.w, a.pts, a.cls, 'cluster', true FROM r a WHERE a.n % 2 = 1 AND NOT EXISTS (SELECT 1 FROM st WHERE st.f = a.f AND st.i = a.i)
  UNION ALL SELECT b.f, b.cx, b.cy, b.l, b.w, 0, b.cls, 'detector', false FROM r b WHERE b.n % 2 = 0 AND NOT EXISTS (SELECT 1 FROM st WHERE st.f = b.f AND st.j = b.i))
SELECT f AS sample_token, cx, cy, l, w, pts, cls AS cls_pred, source, missed AS missed_by_model, round_even(sqrt(cx * cx + cy * cy), 6) AS dist_m FROM u
"""


def flip_consistency(spark, d):
    """Matched detections of two detector passes and their inconsistency."""
    g = _coarse(spark, d).withColumn("label", (F.col("pts") % 2).cast("int"))
    return mt.flip_flagged(g, F.col("l_linenumber") % 2 == 0, delta=2.5).select("sample_token", "n1", "n2", "matched", bround6(F.col("inc")).alias("inc"))


FLIP_SQL = f"""
WITH RECURSIVE {_COARSE},
s AS (SELECT f, list({{'x': cx, 'y': cy, 'l': pts % 2}} ORDER BY score DESC, cx, cy, pts % 2) FILTER (n % 2 = 1) AS a, list({{'x': cx, 'y': cy, 'l': pts % 2, 'n': n}} ORDER BY cx, cy, pts % 2) FILTER (n % 2 = 0) AS b FROM g GROUP BY f),
p AS (
  SELECT f, 1 AS k, coalesce(a, []) AS a, coalesce(b, []) AS free, 0 AS matched, coalesce(len(a), 0) AS n1, coalesce(len(b), 0) AS n2 FROM s
  UNION ALL
  SELECT f, k + 1, a, CASE WHEN hit IS NULL THEN free ELSE list_filter(free, lambda x: x.n <> hit.n) END, matched + (hit IS NOT NULL)::INTEGER, n1, n2 FROM (
    SELECT *, list_min(list_transform(list_filter(free, lambda x: x.l = a[k].l AND sqrt((x.x - a[k].x) ** 2 + (x.y - a[k].y) ** 2) < 2.5::DOUBLE), lambda x: {{'d': (x.x - a[k].x) ** 2 + (x.y - a[k].y) ** 2, 'x': x.x, 'y': x.y, 'n': x.n}})) AS hit
    FROM p WHERE k <= len(a)))
SELECT f AS sample_token, n1::INTEGER AS n1, n2::INTEGER AS n2, max(matched)::INTEGER AS matched, round_even(1 - max(matched) / greatest(n1, n2, 1), 6) AS inc FROM p GROUP BY f, n1, n2
"""


def detection_hits(spark, d):
    """Hits of detections (even lines) by falling score against objects (odd lines) of the frame, some of which are ignored."""
    g = _coarse(spark, d).withColumns({"x1": F.col("cx") - 3, "x2": F.col("cx") + 3, "y1": F.col("cy") - F.col("w") / 2, "y2": F.col("cy") + F.col("w") / 2, "ignore": F.col("pts") < 20})
    out = mt.events_flagged(g, F.col("l_linenumber") % 2 == 0, ("sample_token",), 0.4)
    return out.select("sample_token", "score", "hit")


_SHARED = "greatest(0, least(x.cx + 3, b[k].cx + 3) - greatest(x.cx - 3, b[k].cx - 3)) * greatest(0, least(x.cy + x.w / 2, b[k].cy + b[k].w / 2) - greatest(x.cy - x.w / 2, b[k].cy - b[k].w / 2))"
HITS_SQL = f"""
WITH RECURSIVE {_COARSE},
s AS (SELECT f, list({{'cx': cx, 'cy': cy, 'w': w, 's': score}} ORDER BY score DESC, cx, cy - w / 2, cy + w / 2) FILTER (n % 2 = 0) AS b, list({{'cx': cx, 'cy': cy, 'w': w, 'ig': pts < 20, 'n': n}}) FILTER (n % 2 = 1) AS a FROM g GROUP BY f HAVING count(*) FILTER (n % 2 = 0) > 0),
p AS (
  SELECT f, 1 AS k, b, coalesce(a, []) AS free, NULL::DOUBLE AS score, NULL::BOOLEAN AS hit FROM s
  UNION ALL
  SELECT f, k + 1, b, CASE WHEN best IS NULL THEN free ELSE list_filter(free, lambda x: x.n <> best.n) END, CASE WHEN best IS NOT NULL OR len(list_filter(near, lambda x: x.ig)) = 0 THEN b[k].s END, best IS NOT NULL FROM (
    SELECT *, list_min(list_transform(list_filter(near, lambda x: NOT x.ig), lambda x: {{'i': -x.i, 'y1': x.x1, 'y2': x.y1, 'y3': x.y2, 'n': x.n}})) AS best FROM (
      SELECT *, list_filter(list_transform(free, lambda x: {{'i': {_SHARED} / greatest(6 * x.w + 6 * b[k].w - {_SHARED}, 1e-9), 'x1': x.cx, 'y1': x.cy - x.w / 2, 'y2': x.cy + x.w / 2, 'ig': x.ig, 'n': x.n}}), lambda x: x.i >= 0.4::DOUBLE) AS near
      FROM p WHERE k <= len(b))))
SELECT f AS sample_token, score, hit FROM p WHERE k > 1 AND score IS NOT NULL
"""


def tracked_objects(spark, d):
    """Tracks and speeds of at most two objects a frame along each scene."""
    f = order_frames(spark, d).select("scene_token", "sample_token", F.floor(F.col("t") / 1_000_000).alias("timestamp"))
    o = objects(spark, d).filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("sample_token"), F.concat(F.lit("o"), F.col("l_linenumber").cast("string")).alias("object_id"), (F.col("l_quantity") + F.col("l_partkey") / 1000).alias("gx"), (F.col("l_extendedprice") / 5000).alias("gy"))
    out = mt.track(f.join(o, "sample_token", "left"), "scene_token", "sample_token", "timestamp", 1.5, 3.0).filter("object_id is not null")
    return out.select("scene_token", "sample_token", "object_id", "track_id", bround6(F.col("speed_mps")).alias("speed_mps"))


TRACK_SQL = f"""
WITH RECURSIVE {OBJECTS_SQL}, {ORDERS_SQL},
fo AS (SELECT scene_token AS s, sample_token AS f, t // 1000000 AS t, row_number() OVER (PARTITION BY scene_token ORDER BY t // 1000000, sample_token) AS k FROM fr),
ob AS (SELECT s, f, k, t, l_linenumber AS n, l_quantity + l_partkey / 1000 AS x, l_extendedprice / 5000 AS y FROM o JOIN fo ON f = l_orderkey WHERE l_linenumber <= 2),
pr AS (SELECT a.s, a.k, a.n AS i, b.n AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS cost, (b.t - a.t) / 1e6::DOUBLE AS dt FROM ob a JOIN ob b ON a.s = b.s AND b.k = a.k + 1),
pl AS (SELECT s, k, CASE WHEN count(DISTINCT i) = 2 AND count(DISTINCT j) = 2 THEN CASE WHEN sum(cost) FILTER (i = j) <= sum(cost) FILTER (i <> j) THEN 1 ELSE 2 END ELSE 0 END AS plan, arg_min(i * 10 + j, cost) AS one FROM pr GROUP BY 1, 2),
ln AS (SELECT pr.s, pr.k, i, j, cost / dt AS v FROM pr JOIN pl USING (s, k) WHERE CASE plan WHEN 1 THEN i = j WHEN 2 THEN i <> j ELSE i * 10 + j = one END AND dt > 0 AND cost <= 1.5::DOUBLE + 3 * dt),
hd AS (SELECT ob.s, ob.k, ob.n, row_number() OVER (PARTITION BY ob.s ORDER BY ob.k, ob.n) - 1 AS id FROM ob LEFT JOIN ln ON ln.s = ob.s AND ln.k = ob.k - 1 AND ln.j = ob.n WHERE ln.j IS NULL),
tr AS (SELECT s, k, n, id FROM hd UNION ALL SELECT tr.s, tr.k + 1, ln.j, id FROM tr JOIN ln ON ln.s = tr.s AND ln.k = tr.k AND ln.i = tr.n)
SELECT ob.s AS scene_token, ob.f AS sample_token, 'o' || ob.n AS object_id, ob.s || ':t' || id AS track_id, round_even(coalesce(back.v, ahead.v), 6) AS speed_mps
FROM ob JOIN tr USING (s, k, n) LEFT JOIN ln back ON back.s = ob.s AND back.k = ob.k - 1 AND back.j = ob.n LEFT JOIN ln ahead ON ahead.s = ob.s AND ahead.k = ob.k AND ahead.i = ob.n
"""

# Cameras that look ahead and to both sides: name, yaw, place on the vehicle.
_CAMERAS = (("CAM_FRONT", 0.0, 1.7, 0.0, 1.5), ("CAM_FRONT_LEFT", 0.9, 1.5, 0.5, 1.5), ("CAM_FRONT_RIGHT", -0.9, 1.5, -0.5, 1.5))
_K = (1266.4, 0.0, 816.3, 0.0, 1266.4, 491.5, 0.0, 0.0, 1.0)


def _looking(yaw: float) -> list[float]:
    """Quaternion of a camera (z ahead, x right, y down) that looks along ``yaw``."""
    c, s = math.cos(yaw / 2) / 2, math.sin(yaw / 2) / 2
    return [c + s, -c - s, c - s, s - c]


def _array(values):
    return F.array(*[F.lit(float(v)) for v in values])


def _rig(frames):
    """Every camera of every frame with its place and intrinsic matrix."""
    cams = F.explode(F.array(*[F.struct(F.lit(n).alias("cam"), _array((x, y, z)).alias("translation"), _array(_looking(a)).alias("rotation")) for n, a, x, y, z in _CAMERAS])).alias("c")
    return frames.select("*", cams).select(*frames.columns, "c.*").withColumn("intrinsic", _array(_K))


def best_camera_boxes(spark, d):
    """The camera that sees most of each candidate, with its clipped box."""
    o = boxes(spark, d).select("sample_token", "object_id", "cx", "cy", F.lit(0.8).alias("cz"), "l", "w", "h", (F.col("pts") * 0.2).alias("yaw"))
    out = pj.project_objects(o, _rig(order_frames(spark, d).select("sample_token")), 0.3)
    return out.select("sample_token", "object_id", "cam", *[bround6(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2", "visible_frac")])


_CAM_SQL = "cam AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}', {a}::DOUBLE, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for k, (n, a, x, y, z) in enumerate(_CAMERAS)) + ") v(place, cam, ca, tx, ty, tz))"
_SIGNS = "sg AS (SELECT * FROM (VALUES (1), (-1)) a(sx), (VALUES (1), (-1)) b(sy), (VALUES (1), (-1)) c(sz))"
_SEEN = """co AS (SELECT *, cx + cos(yaw) * sx * l / 2 - sin(yaw) * sy * w / 2 - tx AS ex, cy + sin(yaw) * sx * l / 2 + cos(yaw) * sy * w / 2 - ty AS ey, cz + sz * h / 2 - tz AS ez FROM bx, cam, sg),
un AS (SELECT *, cos(ca) * ex + sin(ca) * ey AS depth, (1266.4::DOUBLE * (sin(ca) * ex - cos(ca) * ey)) / (cos(ca) * ex + sin(ca) * ey) + 816.3::DOUBLE AS u, 1266.4::DOUBLE * -ez / (cos(ca) * ex + sin(ca) * ey) + 491.5::DOUBLE AS v FROM co)"""
BEST_SQL = f"""
WITH {BOXES_SQL}, {_CAM_SQL}, {_SIGNS}, bx AS (SELECT sample_token, object_id, cx, cy, 0.8::DOUBLE AS cz, l, w, h, pts * 0.2::DOUBLE AS yaw FROM b), {_SEEN},
pe AS (SELECT sample_token, object_id, cam, place, least(greatest(min(u), 0), 1600) AS x1, least(greatest(min(v), 0), 900) AS y1, least(greatest(max(u), 0), 1600) AS x2, least(greatest(max(v), 0), 900) AS y2, (max(u) - min(u)) * (max(v) - min(v)) AS full_area FROM un GROUP BY 1, 2, 3, 4 HAVING min(depth) > 0.1::DOUBLE),
vi AS (SELECT *, (x2 - x1) * (y2 - y1) / full_area AS vis FROM pe WHERE full_area > 0)
SELECT sample_token, object_id, cam, round_even(x1, 6) AS x1, round_even(y1, 6) AS y1, round_even(x2, 6) AS x2, round_even(y2, 6) AS y2, round_even(vis, 6) AS visible_frac FROM vi WHERE vis > 0
QUALIFY row_number() OVER (PARTITION BY sample_token, object_id ORDER BY round(vis, 9) DESC, place) = 1 AND vis >= 0.3::DOUBLE
"""


def camera_label_boxes(spark, d):
    """Global label boxes in every camera with all corners in front and one inside the image."""
    ego = order_frames(spark, d).select("sample_token", _turn((F.col("scene_token") % 7) * 0.4).alias("ego_q"), F.array((F.col("scene_token") * 0.5), F.lit(3.0), F.lit(0.2)).alias("ego_t"))
    b = boxes(spark, d).join(order_frames(spark, d).select("sample_token", "scene_token"), "sample_token").select(
        "sample_token", F.col("object_id").alias("ann_token"), F.col("cls_pred").alias("category"), F.array(F.col("cx") + F.col("scene_token") * 0.5, F.col("cy") + 3, F.lit(1.0)).alias("translation"), F.array("w", "l", "h").alias("size"),
        _turn(F.col("pts") * 0.2).alias("rotation"), F.lit("4").alias("visibility"), F.col("pts").alias("num_lidar_pts"),
    )
    out = pj.project_boxes(b, _rig(ego))
    return out.select("sample_token", "cam", "ann_token", "category", *[bround6(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2", "depth")], "num_lidar_pts")


LABELS_SQL = f"""
WITH {BOXES_SQL}, {ORDERS_SQL}, {_CAM_SQL}, {_SIGNS},
gl AS (SELECT b.*, (scene_token % 7) * 0.4::DOUBLE AS a FROM b JOIN fr USING (sample_token)),
bx AS (SELECT sample_token, object_id, cls_pred, pts, cos(a) * cx + sin(a) * cy AS cx, cos(a) * cy - sin(a) * cx AS cy, 0.8::DOUBLE AS cz, l, w, h, pts * 0.2::DOUBLE - a AS yaw FROM gl), {_SEEN}
SELECT sample_token, cam, object_id AS ann_token, cls_pred AS category, round_even(least(greatest(min(u), 0), 1600), 6) AS x1, round_even(least(greatest(min(v), 0), 900), 6) AS y1, round_even(least(greatest(max(u), 0), 1600), 6) AS x2, round_even(least(greatest(max(v), 0), 900), 6) AS y2,
       round_even(max(cos(ca) * (cx - tx) + sin(ca) * (cy - ty)), 6) AS depth, max(pts) AS num_lidar_pts
FROM un GROUP BY 1, 2, 3, 4 HAVING min(depth) > 0.1::DOUBLE AND bool_or(u >= 0 AND u < 1600 AND v >= 0 AND v < 900)
"""

QUERIES = {
    "detector_boxes": (detector_boxes, DETECTOR_SQL),
    "world_positions": (world_positions, WORLD_SQL),
    "merged_candidates": (merged_candidates, MERGED_SQL),
    "flip_consistency": (flip_consistency, FLIP_SQL),
    "detection_hits": (detection_hits, HITS_SQL),
    "tracked_objects": (tracked_objects, TRACK_SQL),
    "best_camera_boxes": (best_camera_boxes, BEST_SQL),
    "camera_label_boxes": (camera_label_boxes, LABELS_SQL),
}

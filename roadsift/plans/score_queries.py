"""Queries of scoring, labels, gates, tags, context, evaluation and statistics over lineitems as objects of orders (frames)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.ranks import bround6
from ..functions.scalars import shape_score, sun_elevation, surprisal, top_reasons
from ..operators import aggregates as agg
from ..operators import context as ctx
from ..operators import evaluation as ev
from ..operators import labels as lab
from ..operators import scoring as sc
from ..operators import splits as sp
from ..operators.joins import adjacent_speed, by_time_position
from ..operators.selection import budget_rows, label_oracle, track_penalty
from ..scratch import written
from .frames import FRAMES_SQL, OBJECTS_SQL, frames, micros, objects, table

# ---- the same objects in both engines -------------------------------------------------
_CLASS = {"A": "pedestrian", "N": "bicycle", "R": "other"}


def boxes(spark, d):
    """Objects with class, distance, points, sides, position, speed and a track."""
    return objects(spark, d).select(
        F.col("l_orderkey").alias("sample_token"), F.concat(F.lit("o"), F.col("l_linenumber").cast("string")).alias("object_id"), F.create_map(*[F.lit(x) for kv in _CLASS.items() for x in kv])[F.col("l_returnflag")].alias("cls_pred"),
        F.col("l_quantity").alias("dist_m"), F.floor(F.col("l_discount") * 200 + 1e-9).cast("int").alias("pts"), (F.col("l_tax") * 10 + 1).alias("l"), (F.col("l_tax") * 5 + 0.5).alias("w"), (F.col("l_quantity") / 50 + 1).alias("h"),
        (F.col("l_quantity") - 25).alias("cx"), (F.col("l_discount") * 100 - 5).alias("cy"), F.when(F.col("l_tax") > 0.02, F.col("l_tax") * 20).alias("speed_mps"), (F.col("l_partkey") % 300).cast("string").alias("track_id"), "l_extendedprice", "l_linestatus",
    )


BOXES_SQL = f"""
{OBJECTS_SQL},
b AS (
  SELECT l_orderkey AS sample_token, 'o' || l_linenumber AS object_id, CASE l_returnflag WHEN 'A' THEN 'pedestrian' WHEN 'N' THEN 'bicycle' ELSE 'other' END AS cls_pred,
         l_quantity AS dist_m, floor(l_discount * 200 + 1e-9)::INTEGER AS pts, l_tax * 10 + 1 AS l, l_tax * 5 + 0.5::DOUBLE AS w, l_quantity / 50 + 1 AS h,
         l_quantity - 25 AS cx, l_discount * 100 - 5 AS cy, CASE WHEN l_tax > 0.02::DOUBLE THEN l_tax * 20 END AS speed_mps, (l_partkey % 300)::VARCHAR AS track_id, l_extendedprice, l_linestatus FROM o)
"""


def order_frames(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("sample_token"), F.col("o_custkey").alias("scene_token"), F.when(F.col("o_custkey") % 3 == 0, F.lit("V")).otherwise(F.lit("P")).alias("split"), F.col("o_orderpriority").alias("scene_desc"), "o_totalprice", "o_orderstatus", micros("o_orderdate").alias("t"))


ORDERS_SQL = "fr AS (SELECT o_orderkey AS sample_token, o_custkey AS scene_token, CASE WHEN o_custkey % 3 = 0 THEN 'V' ELSE 'P' END AS split, o_orderpriority AS scene_desc, o_totalprice, o_orderstatus, epoch_us(o_orderdate) AS t FROM orders)"


def cell_rarity(spark, d):
    b = boxes(spark, d).select("sample_token", F.col("cls_pred").alias("cls"), "dist_m", F.col("pts").alias("num_lidar_pts"), F.lit("4").alias("visibility"))
    out = lab.cell_rarity(order_frames(spark, d).withColumn("scene_desc", F.lower("scene_desc")), b, 0.25)
    return out.select("sample_token", "is_rare", "C_sensor", "n_boxes", "rare_cells")


CELL_SQL = f"""
WITH {BOXES_SQL}, {ORDERS_SQL},
c AS (SELECT b.sample_token, split, cls_pred || '|d' || (CASE WHEN dist_m < 20 THEN 0 WHEN dist_m < 40 THEN 1 ELSE 2 END) || '|p' || (CASE WHEN pts < 5 THEN 0 WHEN pts < 20 THEN 1 ELSE 2 END) AS cell FROM b JOIN fr USING (sample_token)),
n AS (SELECT split, count(*) AS n FROM fr GROUP BY 1),
q AS (SELECT split, cell, count(DISTINCT sample_token) / max(n) AS freq FROM c JOIN n USING (split) GROUP BY 1, 2),
r AS (SELECT sample_token, string_agg(DISTINCT cell, '|' ORDER BY cell) AS cells FROM c JOIN q USING (split, cell) WHERE freq < 0.25 GROUP BY 1),
a AS (SELECT sample_token, count(*) AS n_boxes, bool_or(pts <= 5 AND dist_m > 40) AS sensor FROM b GROUP BY 1)
SELECT fr.sample_token, cells IS NOT NULL AS is_rare, coalesce(sensor, false) AS "C_sensor", coalesce(n_boxes, 0)::BIGINT AS n_boxes, coalesce(cells, '') AS rare_cells
FROM fr LEFT JOIN r USING (sample_token) LEFT JOIN a USING (sample_token)
"""


def group_gated_or(spark, d):
    f = order_frames(spark, d).select("sample_token", (F.col("scene_desc") == "1-URGENT").alias("A"), (F.col("o_totalprice") > 400000).alias("B"), (F.col("o_orderstatus") == "O").alias("C"))
    return agg.gated_or(f, ["A", "B", "C"], 0.35)


def surprisal_reference(spark, d):
    f = order_frames(spark, d)
    ref = sc.fit_reference(boxes(spark, d), f)
    return ref.cells.select("cell", bround6(surprisal(F.col("cell_p"))).alias("u"))


def _edges_sql(v: str) -> str:
    return ", ".join(f"(SELECT cls_pred, v[ceil((len(v) - 1) * {q}::DOUBLE)::BIGINT + 1] AS e FROM (SELECT cls_pred, list({v} ORDER BY {v}) AS v FROM b GROUP BY 1))" for q in (0.25, 0.5, 0.75)).replace("), (", ") UNION (")


REFERENCE_SQL = f"""
{BOXES_SQL}, {ORDERS_SQL},
ed AS ({_edges_sql('dist_m')}), ep AS ({_edges_sql('pts')}),
cb AS (SELECT b.*, cls_pred || '|d' || (SELECT count(*) FROM ed WHERE ed.cls_pred = b.cls_pred AND e <= dist_m) || '|p' || (SELECT count(*) FROM ep WHERE ep.cls_pred = b.cls_pred AND e <= pts) AS cell FROM b),
cp AS (SELECT cell, count(DISTINCT sample_token) / (SELECT count(*) FROM fr) AS cell_p FROM cb GROUP BY 1)
"""


def object_scores(spark, d):
    b = boxes(spark, d)
    ref = sc.fit_reference(b, order_frames(spark, d))
    out = sc.score_objects(ref.objects, ref)
    return out.select("sample_token", "object_id", bround6(F.col("score_shape")).alias("score_shape"), bround6(F.col("score_slice")).alias("score_slice"), "score_vru", bround6(F.col("s_obj")).alias("s_obj"))


OBJECT_SQL = f"""
WITH {REFERENCE_SQL},
st AS (SELECT cls_pred, median(l) AS lm, greatest(stddev_pop(l), 0.05) AS ls, median(w) AS wm, greatest(stddev_pop(w), 0.05) AS ws, median(h) AS hm, greatest(stddev_pop(h), 0.05) AS hs FROM b GROUP BY 1),
z AS (SELECT cb.*, cell_p, CASE WHEN cls_pred <> 'other' THEN 1 - exp(-0.5 * greatest(((l - lm) / ls) ** 2, ((w - wm) / ws) ** 2, ((h - hm) / hs) ** 2)) ELSE 0 END AS shape,
        CASE WHEN cls_pred = 'other' THEN 0.0 ELSE 1.0 END AS vru FROM cb JOIN st USING (cls_pred) LEFT JOIN cp USING (cell)),
u AS (SELECT *, -ln(cell_p) AS u FROM z),
rk AS (SELECT sample_token, object_id, (rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2.0) / count(*) OVER () AS r FROM u WHERE vru > 0)
SELECT u.sample_token, u.object_id, round_even(shape, 6) AS score_shape, round_even(coalesce(r, 0)::DOUBLE, 6) AS score_slice, vru::DOUBLE AS score_vru,
       round_even(least(1.0, greatest(0.0, 0.15::DOUBLE * shape + 0.35::DOUBLE * coalesce(r, 0)::DOUBLE + 0.3::DOUBLE * vru::DOUBLE)), 6) AS s_obj
FROM u LEFT JOIN rk ON rk.sample_token = u.sample_token AND rk.object_id = u.object_id
"""


def frame_rhcio_tags(spark, d):
    b = boxes(spark, d).drop("object_id", "track_id", "l_linestatus")
    f = order_frames(spark, d).select("sample_token", F.when(F.col("o_orderstatus") == "P", F.lit("outlier")).otherwise(F.lit("valid")).alias("gate"), F.when(F.col("scene_desc") == "1-URGENT", F.lit("rain")).otherwise(F.lit("")).alias("weather_pred"), F.lit(None).cast("double").alias("sun_elev_deg"))
    ref = sc.fit_reference(b, order_frames(spark, d))
    out = sc.frame_tags(ref.objects.withColumn("s_obj", F.col("l_extendedprice") / 100000), f, ref, evidence=False)
    return out.select("sample_token", "gate", F.col("crowd").cast("long").alias("crowd"), bround6(F.col("s_frame")).alias("s_frame"), "pred_tags")


TAGS_SQL = f"""
WITH {REFERENCE_SQL},
cl AS (SELECT cls_pred, count(*) / (SELECT count(*) FROM b) AS class_p FROM b GROUP BY 1),
x AS (SELECT cb.*, -ln(class_p) AS u1, -ln(cell_p) AS u2, cls_pred <> 'other' AS vru FROM cb JOIN cl USING (cls_pred) JOIN cp USING (cell)),
pf AS (SELECT fr.sample_token, coalesce(max(u1), 0.0) AS m1, coalesce(max(u2), 0.0) AS m2 FROM fr LEFT JOIN x USING (sample_token) GROUP BY 1),
th AS (SELECT (list(m1 ORDER BY m1))[ceil((count(*) - 1) * 0.9::DOUBLE)::BIGINT + 1] AS t1, (list(m2 ORDER BY m2))[ceil((count(*) - 1) * 0.9::DOUBLE)::BIGINT + 1] AS t2 FROM pf),
pe AS (SELECT sample_token, max(l_extendedprice / 100000) AS so, count(*) FILTER (vru) AS crowd, bool_or(vru AND u1 > t1) AS r1, bool_or(vru AND u2 > t2) AS r2, coalesce(bool_or(vru AND speed_mps >= 0.5), false) AS mv,
         bool_or(dist_m > 30 OR pts < 10) AS hd, coalesce(bool_or(vru AND speed_mps >= 0.5 AND cx > 0 AND cx <= 20 AND abs(cy) <= 4), false) AS ic FROM x, th GROUP BY 1),
g AS (SELECT fr.sample_token, CASE WHEN o_orderstatus = 'P' THEN 'outlier' ELSE 'valid' END AS gate, scene_desc = '1-URGENT' AS bad, so, crowd, r1, r2, mv, hd, ic FROM fr LEFT JOIN pe USING (sample_token)),
rw AS (SELECT *, 0.7::DOUBLE * (CASE WHEN gate = 'valid' THEN coalesce(so, 0) ELSE 0 END) + 0.15::DOUBLE * least((CASE WHEN gate = 'valid' THEN coalesce(crowd, 0) ELSE 0 END) / 5.0::DOUBLE, 1.0) + 0.15::DOUBLE * (CASE WHEN bad THEN 0.3::DOUBLE ELSE 0 END) AS raw FROM g),
rk AS (SELECT sample_token, (rank() OVER (ORDER BY raw) + (count(*) OVER (PARTITION BY raw) - 1) / 2.0) / count(*) OVER () AS r FROM rw WHERE gate = 'valid')
SELECT rw.sample_token, gate, coalesce(crowd, 0)::BIGINT AS crowd, round_even(coalesce(r, 0)::DOUBLE, 6) AS s_frame,
       concat_ws('|', CASE WHEN r1 AND gate = 'valid' THEN 'R1' END, CASE WHEN r2 AND gate = 'valid' THEN 'R2' END, CASE WHEN mv AND bad AND gate = 'valid' THEN 'R3' END, CASE WHEN hd AND gate = 'valid' THEN 'H' END, CASE WHEN bad THEN 'C' END, CASE WHEN ic AND gate = 'valid' THEN 'I' END) AS pred_tags
FROM rw LEFT JOIN rk USING (sample_token)
"""


def gate_frames(spark, d):
    f = order_frames(spark, d).select("sample_token", (F.col("o_orderstatus") != "P").alias("keep"), (F.col("o_totalprice") / 50000).alias("deviation"), F.lit(1.0).alias("spread"))
    return sc.gate(f, boxes(spark, d), min_points=12, sigma=1.5).select("sample_token", "gate", "gate_fail", "ood_flag")


GATE_SQL = f"""
WITH {BOXES_SQL}, {ORDERS_SQL}, a AS (SELECT sample_token, count(*) AS n, max(pts) AS p FROM b GROUP BY 1),
g AS (SELECT fr.sample_token, o_totalprice / 50000 AS dv, CASE WHEN o_orderstatus = 'P' THEN 'lidar_filtered' WHEN n IS NULL THEN 'no_candidates' WHEN o_totalprice / 50000 > 3 THEN 'ood' WHEN p < 12 THEN 'all_below_min_pts' ELSE '' END AS gate_fail FROM fr LEFT JOIN a USING (sample_token))
SELECT sample_token, CASE gate_fail WHEN 'lidar_filtered' THEN 'outlier' WHEN '' THEN 'valid' ELSE 'suspect' END AS gate, gate_fail, dv > 1.5 AS ood_flag FROM g
"""


def track_penalty_query(spark, d):
    return track_penalty(boxes(spark, d), "sample_token", "track_id", "l_extendedprice")


def image_and_frame_scores(spark, d):
    """Events as images: camera by event type, frame = user and day."""
    f = frames(spark, d)
    cams = {"click": "CAM_FRONT", "view": "CAM_BACK", "purchase": "CAM_FRONT_LEFT"}
    cam = F.coalesce(F.create_map(*[F.lit(x) for kv in cams.items() for x in kv])[F.col("event_type")], F.lit("CAM_BACK_RIGHT"))
    img = f.select(
        F.concat_ws(":", F.col("user_id").cast("string"), F.floor(F.col("t") / 86_400_000_000).cast("string")).alias("sample_token"), cam.alias("cam"), F.col("user_id").cast("string").alias("scene_token"), F.lit("pool").alias("split"), F.lit(0).alias("frame_idx"),
        F.col("value").alias("nov_knn"), (F.col("value") % 7).alias("unc"), (F.col("event_id") % 11).cast("double").alias("qry_max"), F.lit("q").alias("qry_best"), (F.col("event_id") % 5 != 0).alias("q_ok"), F.lit(1).alias("det_n_conf"), "event_id",
    )
    first = agg.first_by(img, ["sample_token", "cam"], [F.col("event_id").asc()])
    return sc.frame_scores(first, (0.4, 0.3, 0.3)).select("sample_token", "best_cam", "S_hybrid", bround6(F.col("S_nov")).alias("S_nov"), "q_ok", "n_cams")


def _cam_rank(x: str) -> str:
    return f"CASE WHEN q_ok THEN ((rank() OVER (PARTITION BY q_ok ORDER BY {x}) + (count(*) OVER (PARTITION BY q_ok, {x}) - 1) / 2.0) / count(*) OVER (PARTITION BY q_ok))::DOUBLE ELSE 0.0 END"


IMAGE_SQL = f"""
WITH {FRAMES_SQL},
i AS (SELECT user_id || ':' || (t // 86400000000) AS sample_token, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 4 ELSE 6 END AS o, CASE event_type WHEN 'click' THEN 'CAM_FRONT' WHEN 'view' THEN 'CAM_BACK' WHEN 'purchase' THEN 'CAM_FRONT_LEFT' ELSE 'CAM_BACK_RIGHT' END AS cam, value AS nov, value % 7 AS unc, (event_id % 11)::DOUBLE AS qry, event_id % 5 <> 0 AS q_ok, event_id FROM f),
k AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY sample_token, cam ORDER BY event_id) = 1),
r AS (SELECT *, {_cam_rank('nov')} AS rn, {_cam_rank('unc')} AS ru, {_cam_rank('qry')} AS rq FROM k),
s AS (SELECT *, CASE WHEN q_ok THEN 0.4::DOUBLE * rn + 0.3::DOUBLE * ru + 0.3::DOUBLE * rq ELSE 0.0 END AS s FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY sample_token ORDER BY CASE WHEN q_ok THEN s ELSE -1 END DESC, o) AS n FROM s),
a AS (SELECT sample_token, max(rn) AS m, bool_or(q_ok) AS any_ok, count(*) AS c FROM s GROUP BY 1)
SELECT b.sample_token, cam AS best_cam, round_even(s, 6) AS "S_hybrid", round_even(m, 6) AS "S_nov", any_ok AS q_ok, c AS n_cams FROM b JOIN a USING (sample_token) WHERE n = 1
"""


def reasons(spark, d):
    b = boxes(spark, d)
    parts = [("novelty", F.col("l_extendedprice") / 60000), ("uncertainty", F.col("dist_m") / 50), ("query", F.col("pts") / 20)]
    return b.select("sample_token", "object_id", top_reasons(parts).alias("reason"))


REASON_SQL = f"""
WITH {BOXES_SQL}, p AS (SELECT sample_token, object_id, unnest(['novelty', 'uncertainty', 'query']) AS n, unnest([0, 1, 2]) AS i, unnest([l_extendedprice / 60000, dist_m / 50, pts / 20]) AS v FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY sample_token, object_id ORDER BY v DESC, i) AS r FROM p WHERE v >= 0.8),
t AS (SELECT sample_token, object_id, string_agg(n || ' p' || floor(v * 100 + 1e-9)::INTEGER, ' · ' ORDER BY r) AS reason FROM k WHERE r <= 2 GROUP BY 1, 2)
SELECT b.sample_token, b.object_id, coalesce(reason, 'balanced candidate') AS reason FROM b LEFT JOIN t USING (sample_token, object_id)
"""


# ---- context ---------------------------------------------------------------------------
_THR = {"glare_sat_frac": 0.05, "glare_blob": 30.0, "tile_range": 40.0, "night_v_mean": 8.0, "blur_sharp_ratio": 0.02, "veil": 0.09}


def _quality(spark, d):
    return objects(spark, d).select("l_orderkey", "l_linenumber", F.col("l_discount").alias("sat_frac"), F.col("l_quantity").alias("blob_max_frac"), F.col("l_quantity").alias("tile_range"), F.col("l_quantity").alias("v_mean"), F.col("l_tax").alias("sharp_ratio"), F.col("l_discount").alias("veil"), "l_returnflag", (F.col("l_extendedprice") % 1000 / 1000).alias("margin"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity") - 20).alias("sun"))


_Q_SQL = f"WITH {OBJECTS_SQL}, q AS (SELECT l_orderkey, l_linenumber, l_discount AS sat, l_quantity AS q, l_tax AS sharp, l_returnflag, l_extendedprice % 1000 / 1000 AS margin, CASE WHEN l_linestatus = 'F' THEN l_quantity - 20 END AS sun FROM o), g AS (SELECT *, q < 8 AS night, (sat >= 0.05 AND q >= 30) OR (q >= 40 AND sat >= 0.05) AS glare, sharp < 0.02 AS blur, sat >= 0.09 AS veil FROM q)"


def cv_flags(spark, d):
    return _quality(spark, d).select("l_orderkey", "l_linenumber", *[c.alias(n.lower()) for n, c in ctx.cv_flags(_THR).items()])


def context_decision(spark, d):
    q = _quality(spark, d)
    flags = ctx.cv_flags(_THR)
    cls = {a: F.when(F.col("l_returnflag") == "A", F.lit(x)).when(F.col("l_returnflag") == "N", F.lit(y)).otherwise(F.lit(z)) for a, (x, y, z) in {"illum": ("day", "night", "lowlight"), "glare": ("none", "sun", "lamp"), "lens": ("clean", "drops", "dirt"), "weather": ("dry", "rain", "fog")}.items()}
    out = q.select("l_orderkey", "l_linenumber", *[ctx.decide(a, cls[a], F.col("margin"), 0.3, flags, F.col("sun")).alias(a) for a in ctx.AXES])
    return out.select("l_orderkey", "l_linenumber", *[F.concat(F.coalesce(F.col(f"{a}.tag"), F.lit("-")), F.lit(":"), F.col(f"{a}.status")).alias(a) for a in ctx.AXES])


CONTEXT_SQL = _Q_SQL + """
, c AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'day' WHEN 'N' THEN 'night' ELSE 'lowlight' END AS il, CASE l_returnflag WHEN 'A' THEN 'none' WHEN 'N' THEN 'sun' ELSE 'lamp' END AS gl,
   CASE l_returnflag WHEN 'A' THEN 'clean' WHEN 'N' THEN 'drops' ELSE 'dirt' END AS le, CASE l_returnflag WHEN 'A' THEN 'dry' WHEN 'N' THEN 'rain' ELSE 'fog' END AS we,
   CASE WHEN sun < -6 THEN 'night' WHEN sun < 6 THEN 'lowlight' ELSE 'day' END AS band FROM g)
SELECT l_orderkey, l_linenumber,
  CASE WHEN sun IS NOT NULL AND margin >= 0.3 AND ((il = 'day' AND band = 'night') OR (il = 'night' AND band = 'day')) THEN '-:DISAGREE' WHEN sun IS NOT NULL THEN band || ':OK' WHEN margin < 0.3 THEN '-:SOFT'
       WHEN il = 'night' AND NOT (night OR glare OR margin >= 0.6) THEN '-:SOFT' ELSE il || ':OK' END AS illum,
  CASE WHEN gl = 'none' AND glare AND margin >= 0.3 THEN '-:DISAGREE' WHEN gl = 'none' THEN 'none:OK' WHEN gl = 'sun' AND coalesce(sun < 0, false) THEN '-:SOFT' WHEN (glare OR veil) AND margin >= 0.3 THEN 'glare_' || gl || ':OK'
       WHEN margin >= 0.6 THEN 'glare_' || gl || ':OK' WHEN margin >= 0.3 THEN '-:DISAGREE' ELSE '-:SOFT' END AS glare,
  CASE WHEN le = 'clean' AND margin >= 0.3 THEN 'clean:OK' WHEN le = 'clean' OR margin < 0.3 THEN '-:SOFT' WHEN blur OR veil THEN le || ':OK' ELSE '-:SOFT' END AS lens,
  CASE WHEN coalesce(sun < -6, false) THEN '-:SOFT' WHEN margin < 0.3 THEN '-:SOFT' WHEN we = 'dry' THEN 'dry:OK' WHEN margin >= 0.6 THEN we || ':OK' ELSE '-:SOFT' END AS weather
FROM c
"""


def threshold_fit(spark, d):
    q = _quality(spark, d)
    return q.filter("l_returnflag = 'N'").agg(*[bround6(F.percentile(c, F.lit(p))).alias(n) for n, (c, p) in ctx.FLAG_QUANTILES.items()])


def sun_elevation_query(spark, d):
    f = frames(spark, d)
    return f.select("event_id", bround6(sun_elevation(F.col("t"), F.lit(42.36), F.lit(-71.06))).alias("sun"))


SUN_SQL = f"""
WITH {FRAMES_SQL}, a AS (SELECT event_id, t, dayofyear(make_timestamp(t)) AS dd, CASE WHEN year(make_timestamp(t)) % 4 = 0 THEN 366.0 ELSE 365.0 END AS y, (t % 86400000000) / 60000000.0::DOUBLE AS m FROM f),
g AS (SELECT *, 2 * pi() / y * (dd - 1 + (m / 60 - 12) / 24) AS g FROM a),
e AS (SELECT *, 229.18::DOUBLE * (0.000075::DOUBLE + 0.001868::DOUBLE * cos(g) - 0.032077::DOUBLE * sin(g) - 0.014615::DOUBLE * cos(2 * g) - 0.040849::DOUBLE * sin(2 * g)) AS q,
   0.006918::DOUBLE - 0.399912::DOUBLE * cos(g) + 0.070257::DOUBLE * sin(g) - 0.006758::DOUBLE * cos(2 * g) + 0.000907::DOUBLE * sin(2 * g) - 0.002697::DOUBLE * cos(3 * g) + 0.00148::DOUBLE * sin(3 * g) AS dc FROM g)
SELECT event_id, round_even(degrees(asin(least(1.0, greatest(-1.0, sin(radians(42.36)) * sin(dc) + cos(radians(42.36)) * cos(dc) * cos(radians((m + q + 4 * -71.06::DOUBLE) / 4 - 180)))))), 6) AS sun FROM e
"""


# ---- evaluation ------------------------------------------------------------------------
def _selected(spark, d):
    return order_frames(spark, d).orderBy(F.col("o_totalprice").desc(), "sample_token").limit(100)


_SEL_SQL = f"{ORDERS_SQL}, sel AS (SELECT sample_token FROM fr ORDER BY o_totalprice DESC, sample_token LIMIT 100)"


def recall_precision_uplift(spark, d):
    pool = order_frames(spark, d).withColumn("rare", F.col("scene_desc") == "1-URGENT")
    m = ev.selection_metrics(pool, _selected(spark, d), "sample_token", "rare", "scene_token")
    return m.select("hits", *[bround6(F.col(c)).alias(c) for c in ("recall", "precision", "uplift", "n_recall", "coverage", "scene_recall")])


RECALL_SQL = f"""
WITH {_SEL_SQL}, p AS (SELECT fr.*, scene_desc = '1-URGENT' AS rare, sel.sample_token IS NOT NULL AS s FROM fr LEFT JOIN sel USING (sample_token)),
c AS (SELECT count(*) AS n, count(*) FILTER (s) AS ns, count(*) FILTER (rare) AS nr, count(*) FILTER (s AND rare) AS h, count(DISTINCT scene_token) AS sc, count(DISTINCT scene_token) FILTER (s) AS ss, count(DISTINCT scene_token) FILTER (rare) AS sr, count(DISTINCT scene_token) FILTER (s AND rare) AS hs FROM p)
SELECT h AS hits, round_even(h / greatest(nr, 1), 6) AS recall, round_even(h / greatest(ns, 1), 6) AS precision, round_even((h / greatest(nr, 1)) / (ns / n), 6) AS uplift, round_even(h / greatest(least(ns, nr), 1), 6) AS n_recall, round_even(ss / greatest(sc, 1), 6) AS coverage, round_even(hs / greatest(sr, 1), 6) AS scene_recall FROM c
"""


def instance_yield(spark, d):
    pairs = boxes(spark, d).filter("cls_pred = 'pedestrian' and dist_m > 45").select("sample_token", F.col("track_id").alias("inst"))
    m = ev.instance_yield(pairs, _selected(spark, d), "sample_token", "inst", 100)
    oracle, random = F.lit(1.2), F.lit(0.05)
    return m.select("captured", "targets", bround6(F.col("iy")).alias("iy"), bround6(F.col("recall")).alias("recall"), bround6(ev.normalised_yield(F.col("iy"), random, oracle)).alias("n_iy"))


def ap101(spark, d):
    e = boxes(spark, d).filter("cls_pred = 'bicycle'").select((F.col("sample_token") * 100 + F.substring("object_id", 2, 3).cast("int")).alias("o"), F.col("l_extendedprice").alias("score"), (F.col("dist_m") > 25).alias("hit"))
    return ev.average_precision(e, e.filter("hit").count() + 500, "score", "hit", "o").select(bround6(F.col("ap")).alias("ap"))


AP_SQL = f"""
WITH {BOXES_SQL}, e AS (SELECT sample_token * 100 + substr(object_id, 2)::INTEGER AS o, l_extendedprice AS score, dist_m > 25 AS hit FROM b WHERE cls_pred = 'bicycle'),
n AS (SELECT count(*) FILTER (hit) + 500 AS n FROM e),
c AS (SELECT row_number() OVER w AS i, sum(hit::INT) OVER w AS tp FROM e WINDOW w AS (ORDER BY score DESC, o ROWS UNBOUNDED PRECEDING)),
v AS (SELECT i, tp / n AS r, max(tp / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM c, n),
l AS (SELECT unnest(range(0, 101)) / 100.0::DOUBLE AS lv)
SELECT round_even(sum(coalesce((SELECT max(p) FROM v WHERE r >= lv - 1e-12), 0)) / 101, 6) AS ap FROM l
"""


def auroc(spark, d):
    return ev.auroc(boxes(spark, d).select(F.floor(F.col("l_extendedprice") / 10).alias("s"), (F.col("dist_m") > 30).alias("p")), "s", "p").select(bround6(F.col("auroc")).alias("auroc"))


def cohen_kappa(spark, d):
    t = table(spark, d, "labels")
    return ev.cohen_kappa(t.select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b")), "a", "b").select(bround6(F.col("kappa")).alias("kappa"))


def holm(spark, d):
    p = table(spark, d, "nation").select("n_nationkey", (((F.col("n_nationkey") * 7) % 25 + 1) / 400).alias("p"))
    return ev.holm(p, "n_nationkey", "p").select("n_nationkey", bround6(F.col("p_holm")).alias("p_holm"))


def tau_calibration(spark, d):
    return ev.largest_tau(boxes(spark, d).filter("cls_pred = 'pedestrian'").select((F.col("dist_m") / 50).alias("s")), "s", 0.6).select(bround6(F.col("tau")).alias("tau"), "found")


def bootstrap_ratio_ci(spark, d):
    """Customers' nations as scenes, two methods, hash draws shared by both."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    stats = o.select("c_nationkey", F.when(F.col("o_orderstatus") == "F", F.lit("M0")).otherwise(F.lit("M1")).alias("method"), (F.col("o_totalprice") > 200000).alias("hit")).groupBy("method", "c_nationkey").agg(F.count_if("hit").alias("cap"), F.count(F.lit(1)).alias("n_sel"))
    draws = ev.hash_draws(spark, stats, "c_nationkey", 200, 5)
    values = ev.bootstrap_ratio(stats, draws, "method", "c_nationkey", "cap", "n_sel")
    return ev.paired_ci(values, "method", "M1", "M0").select(*[bround6(F.col(c)).alias(c) for c in ("mean", "low", "high")])


BOOT_SQL = """
WITH s AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'M0' ELSE 'M1' END AS m, c_nationkey AS k, count(*) FILTER (o_totalprice > 200000) AS cap, count(*) AS ns FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
k AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT k FROM s)),
g AS (SELECT b, j, ('0x' || substr(md5('5|' || b || '|' || j), 1, 12))::BIGINT % (SELECT max(n) FROM k) AS i FROM (SELECT unnest(range(0, 200)) AS b), (SELECT unnest(range(0, (SELECT max(n) FROM k))) AS j)),
w AS (SELECT b, k, count(*) AS w FROM g JOIN k USING (i) GROUP BY 1, 2),
v AS (SELECT b, m, sum(w * cap) / greatest(sum(w * ns), 1) AS v FROM w JOIN s USING (k) GROUP BY 1, 2),
dd AS (SELECT a.v - c.v AS x FROM v a JOIN v c ON a.b = c.b AND a.m = 'M1' AND c.m = 'M0')
SELECT round_even(avg(x), 6) AS mean, round_even(quantile_cont(x, 0.025), 6) AS low, round_even(quantile_cont(x, 0.975), 6) AS high FROM dd
"""


def _ap_events(spark, d):
    """Bicycles as ranked detections in forty scenes."""
    e = boxes(spark, d).filter("cls_pred = 'bicycle'")
    return written(e.select((F.col("sample_token") % 40).alias("k"), (F.col("sample_token") * 100 + F.substring("object_id", 2, 3).cast("int")).alias("o"), F.col("l_extendedprice").alias("score"), (F.col("dist_m") * 1000 - F.col("cy")).alias("other"), (F.col("dist_m") > 25).alias("hit")), "ranked-events")  # read for every statistic


def _ap_draws(spark, e, score):
    truth = written(e.groupBy("k").agg((F.count_if("hit") + 5).alias("n_truth")), "scene-truth")
    return ev.bootstrap_ap(e, truth, ev.hash_draws(spark, truth, "k", 200, 9), "k", score, "hit", "o")


def bootstrap_ap(spark, d):
    """AP of 200 resamplings of scenes; the events are sorted once for all of them."""
    return _ap_draws(spark, _ap_events(spark, d), "score").select("b", bround6(F.col("ap")).alias("ap"))


def paired_ap_ci(spark, d):
    """Interval of the difference in AP of two detectors over the same draws."""
    e = _ap_events(spark, d)
    both = [_ap_draws(spark, e, c).select("b", F.lit(c).alias("m"), F.col("ap").alias("value")) for c in ("other", "score")]
    return ev.paired_ci(both[0].unionByName(both[1]), "m", "other", "score").select(*[bround6(F.col(c)).alias(c) for c in ("mean", "low", "high")])


def _boot_ap_sql(score: str) -> str:
    return f"""
c_{score} AS (SELECT w.b, sum(w * hit::INT) OVER p AS tp, sum(w) OVER p AS n FROM w JOIN e USING (k) WINDOW p AS (PARTITION BY b ORDER BY {score} DESC, k, o ROWS UNBOUNDED PRECEDING)),
m_{score} AS (SELECT b, floor(tp / truth * 100 + 1e-9)::INTEGER AS l, max(tp / n) AS p FROM c_{score} JOIN s USING (b) GROUP BY 1, 2),
x_{score} AS (SELECT s.b, lv.l, max(p) AS p FROM s CROSS JOIN lv LEFT JOIN m_{score} m ON m.b = s.b AND m.l >= lv.l GROUP BY 1, 2),
ap_{score} AS (SELECT b, sum(coalesce(p, 0)) / 101 AS ap FROM x_{score} GROUP BY b)"""


_BOOT_AP = f"""
WITH {BOXES_SQL},
e AS (SELECT sample_token % 40 AS k, sample_token * 100 + substr(object_id, 2)::INTEGER AS o, l_extendedprice AS score, dist_m * 1000 - cy AS other, dist_m > 25 AS hit FROM b WHERE cls_pred = 'bicycle'),
t AS (SELECT k, count(*) FILTER (hit) + 5 AS n FROM e GROUP BY k),
i AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM t),
g AS (SELECT b, j, ('0x' || substr(md5('9|' || b || '|' || j), 1, 12))::BIGINT % (SELECT max(n) FROM i) AS i FROM (SELECT unnest(range(0, 200)) AS b), (SELECT unnest(range(0, (SELECT max(n) FROM i))) AS j)),
w AS (SELECT b, k, count(*) AS w FROM g JOIN i USING (i) GROUP BY 1, 2),
s AS (SELECT b, sum(w * n) AS truth FROM w JOIN t USING (k) GROUP BY b),
lv AS (SELECT unnest(range(0, 101)) AS l)
"""
BOOT_AP_SQL = f"{_BOOT_AP}, {_boot_ap_sql('score')} SELECT b, round_even(ap, 6) AS ap FROM ap_score"
PAIRED_AP_SQL = f"""{_BOOT_AP}, {_boot_ap_sql('score')}, {_boot_ap_sql('other')}, dd AS (SELECT o.ap - s.ap AS x FROM ap_other o JOIN ap_score s USING (b))
SELECT round_even(avg(x), 6) AS mean, round_even(quantile_cont(x, 0.025), 6) AS low, round_even(quantile_cont(x, 0.975), 6) AS high FROM dd"""


def base_rates(spark, d):
    f = order_frames(spark, d).select("scene_token", (F.col("scene_desc") == "1-URGENT").alias("r1"), (F.col("o_totalprice") > 400000).alias("r2"), (F.col("o_orderstatus") == "P").alias("h"))
    return agg.base_rates(f, ["r1", "r2", "h"], "scene_token").select("axis", "hits", bround6(F.col("rate")).alias("rate"), "scenes")


def tag_lift(spark, d):
    tags = boxes(spark, d).groupBy("sample_token").agg(F.collect_set("cls_pred").alias("tags"))
    f = order_frames(spark, d).join(tags, "sample_token").withColumn("selected", F.col("o_totalprice") > 300000)
    return agg.tag_lift(f, "tags", "selected").select("tag", "pool", "sel", *[bround6(F.col(c)).alias(c) for c in ("base", "share", "lift")])


def threshold_grid(spark, d):
    f = boxes(spark, d).withColumn("freq", F.col("dist_m") / 50)
    return agg.threshold_grid(f, ["l_linestatus"], "sample_token", "freq", [0.1, 0.25, 0.5]).select("l_linestatus", bround6(F.col("tau")).alias("tau"), "n_rare", "n_frames", bround6(F.col("share")).alias("share"))


def mean_std(spark, d):
    return agg.mean_std(boxes(spark, d), ["cls_pred"], "dist_m").select("cls_pred", bround6(F.col("mean")).alias("mean"), bround6(F.col("std")).alias("std"))


def class_prior(spark, d):
    return agg.class_prior(boxes(spark, d), "cls_pred", "track_id").select("cls_pred", "n", bround6(F.col("p")).alias("p"))


def conditional_frequency(spark, d):
    return agg.conditional_frequency(boxes(spark, d), "l_linestatus", "cls_pred", "track_id").select("l_linestatus", "cls_pred", "n", bround6(F.col("p")).alias("p"))


def scene_split_hash(spark, d):
    return sp.hash_split(table(spark, d, "customer").select("c_name"), "c_name", 3)


def links(spark, d):
    f = frames(spark, d).select(F.col("event_id").cast("string").alias("token"), "user_id", "t", "event_id")
    return sp.linked(f, ["user_id"], ["t", "event_id"]).select("token", "prev", "next")


def keyframes(spark, d):
    return sp.keyframes(frames(spark, d).select("event_id", "user_id", "t"), "user_id", "t").select("event_id", "is_key_frame", "sample_idx")


def instance_speed(spark, d):
    f = frames(spark, d).withColumns({"x": F.col("value"), "y": F.col("value") / 2})
    return f.select("event_id", bround6(adjacent_speed(f, "user_id", "t", "x", "y")).alias("speed"))


def label_oracle_order(spark, d):
    f = order_frames(spark, d).select("sample_token", (F.col("scene_desc") == "1-URGENT").alias("rare"), F.floor(F.col("o_totalprice") / 50000).cast("long").alias("n_cells"))
    return label_oracle(f, "rare", "n_cells", "sample_token", 60, 2).select("sample_token", "n_cells")


def budget_prefix(spark, d):
    f = order_frames(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.col("o_totalprice").desc(), "sample_token")))
    return f.withColumn("b", budget_rows(f, 0.07)).filter("rank <= b").select("sample_token", F.col("rank").cast("long").alias("rank"))


def shape_expression(spark, d):
    return boxes(spark, d).select("sample_token", "object_id", bround6(shape_score([(F.col("l") - 1.5) / 0.4, (F.col("w") - 0.7) / 0.2])).alias("shape"))


def frame_positions(spark, d):
    return by_time_position(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("frame_idx").cast("long").alias("frame_idx"))


_B = f"WITH {BOXES_SQL}"
QUERIES = {
    "cell_rarity": (cell_rarity, CELL_SQL),
    "group_gated_or": (group_gated_or, f"WITH {ORDERS_SQL}, g AS (SELECT sample_token, scene_desc = '1-URGENT' AS A, o_totalprice > 400000 AS B, o_orderstatus = 'O' AS C FROM fr), q AS (SELECT avg(A::INT) AS a, avg(B::INT) AS b, avg(C::INT) AS c FROM g) SELECT sample_token, g.A AS \"A\", g.B AS \"B\", g.C AS \"C\", (g.A AND q.a <= 0.35) OR (g.B AND q.b <= 0.35) OR (g.C AND q.c <= 0.35) AS is_rare FROM g, q"),
    "surprisal_reference": (surprisal_reference, f"WITH {REFERENCE_SQL} SELECT cell, round_even(-ln(cell_p), 6) AS u FROM cp"),
    "object_slice_score": (object_scores, OBJECT_SQL),
    "frame_rhcio_tags": (frame_rhcio_tags, TAGS_SQL),
    "gate_frames": (gate_frames, GATE_SQL),
    "track_penalty": (track_penalty_query, _B + ", k AS (SELECT sample_token FROM b QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY l_extendedprice DESC, sample_token) = 1) SELECT DISTINCT sample_token FROM b WHERE sample_token NOT IN (SELECT sample_token FROM k)"),
    "frame_scores": (image_and_frame_scores, IMAGE_SQL),
    "reasons": (reasons, REASON_SQL),
    "cv_flags": (cv_flags, _Q_SQL + " SELECT l_orderkey, l_linenumber, night, glare, blur, veil FROM g"),
    "context_decision": (context_decision, CONTEXT_SQL),
    "threshold_fit": (threshold_fit, _Q_SQL + " SELECT " + ", ".join(f"round_even(quantile_cont({c}, {p}), 6) AS {n}" for n, c, p in (("glare_sat_frac", "sat", 0.975), ("glare_blob", "q", 0.95), ("tile_range", "q", 0.975), ("veil", "sat", 0.975), ("night_v_mean", "q", 0.025), ("blur_sharp_ratio", "sharp", 0.025))) + " FROM q WHERE l_returnflag = 'N'"),
    "sun_elevation": (sun_elevation_query, SUN_SQL),
    "recall_precision_uplift": (recall_precision_uplift, RECALL_SQL),
    "instance_yield": (instance_yield, f"WITH {BOXES_SQL}, {_SEL_SQL}, t AS (SELECT sample_token, track_id FROM b WHERE cls_pred = 'pedestrian' AND dist_m > 45), c AS (SELECT count(DISTINCT track_id) FILTER (sample_token IN (SELECT sample_token FROM sel)) AS captured, count(DISTINCT track_id) AS targets FROM t) SELECT captured, targets, round_even(captured / 100, 6) AS iy, round_even(captured / greatest(targets, 1), 6) AS recall, round_even((captured / 100 - 0.05::DOUBLE) / (1.2::DOUBLE - 0.05::DOUBLE), 6) AS n_iy FROM c"),
    "ap101": (ap101, AP_SQL),
    "auroc": (auroc, _B + ", s AS (SELECT floor(l_extendedprice / 10) AS s, dist_m > 30 AS p FROM b), r AS (SELECT p, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM s) SELECT round_even((sum(r) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2) / (count(*) FILTER (p) * count(*) FILTER (NOT p)), 6) AS auroc FROM r"),
    "cohen_kappa": (cohen_kappa, "WITH l AS (SELECT avg((quality = toxic)::INT) AS po, avg(quality) AS a, avg(toxic) AS b FROM labels) SELECT round_even((po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) AS kappa FROM l"),
    "holm": (holm, "WITH p AS (SELECT n_nationkey, ((n_nationkey * 7) % 25 + 1) / 400 AS p FROM nation), h AS (SELECT *, row_number() OVER (ORDER BY p, n_nationkey) AS r, count(*) OVER () AS m FROM p) SELECT n_nationkey, round_even(max(least(1.0, (m - r + 1) * p)) OVER (ORDER BY p, n_nationkey ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM h"),
    "tau_calibration": (tau_calibration, _B + ", g AS (SELECT round_even(0.05::DOUBLE + k * 0.01::DOUBLE, 6) AS tau FROM (SELECT unnest(range(0, 91)) AS k)), s AS (SELECT tau, avg((dist_m / 50 >= tau)::INT) AS a FROM b, g WHERE cls_pred = 'pedestrian' GROUP BY 1) SELECT round_even(coalesce(max(tau) FILTER (a >= 0.6), 0.05), 6) AS tau, max(tau) FILTER (a >= 0.6) IS NOT NULL AS found FROM s"),
    "bootstrap_ratio_ci": (bootstrap_ratio_ci, BOOT_SQL),
    "bootstrap_ap": (bootstrap_ap, BOOT_AP_SQL),
    "paired_ap_ci": (paired_ap_ci, PAIRED_AP_SQL),
    "base_rates": (base_rates, f"WITH {ORDERS_SQL}, x AS (SELECT scene_token, unnest(['r1', 'r2', 'h']) AS axis, unnest([scene_desc = '1-URGENT', o_totalprice > 400000, o_orderstatus = 'P']) AS hit FROM fr) SELECT axis, count(*) FILTER (hit) AS hits, round_even(avg(hit::INT), 6) AS rate, count(DISTINCT scene_token) FILTER (hit) AS scenes FROM x GROUP BY 1"),
    "tag_lift": (tag_lift, f"WITH {BOXES_SQL}, {ORDERS_SQL}, t AS (SELECT DISTINCT sample_token, cls_pred FROM b), g AS (SELECT t.*, o_totalprice > 300000 AS s FROM t JOIN fr USING (sample_token)), n AS (SELECT count(DISTINCT sample_token) AS n, count(DISTINCT sample_token) FILTER (s) AS ns FROM g) SELECT cls_pred AS tag, count(*) AS pool, count(*) FILTER (s) AS sel, round_even(count(*) / max(n), 6) AS base, round_even(count(*) FILTER (s) / max(ns), 6) AS share, round_even((count(*) FILTER (s) / max(ns)) / (count(*) / max(n)), 6) AS lift FROM g, n GROUP BY 1"),
    "threshold_grid": (threshold_grid, _B + " SELECT l_linestatus, tau, count(DISTINCT sample_token) FILTER (dist_m / 50 < tau) AS n_rare, count(DISTINCT sample_token) AS n_frames, round_even(count(DISTINCT sample_token) FILTER (dist_m / 50 < tau) / count(DISTINCT sample_token), 6) AS share FROM b, (SELECT unnest([0.1::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE]) AS tau) GROUP BY 1, 2"),
    "mean_std": (mean_std, _B + " SELECT cls_pred, round_even(avg(dist_m), 6) AS mean, round_even(stddev_pop(dist_m), 6) AS std FROM b GROUP BY 1"),
    "class_prior": (class_prior, _B + ", c AS (SELECT cls_pred, count(DISTINCT track_id) AS n FROM b GROUP BY 1) SELECT cls_pred, n, round_even(n / sum(n) OVER (), 6) AS p FROM c"),
    "conditional_frequency": (conditional_frequency, _B + ", t AS (SELECT l_linestatus, count(DISTINCT track_id) AS nc FROM b GROUP BY 1) SELECT b.l_linestatus, cls_pred, count(DISTINCT track_id) AS n, round_even(count(DISTINCT track_id) / max(nc), 6) AS p FROM b JOIN t USING (l_linestatus) GROUP BY 1, 2"),
    "scene_split_hash": (scene_split_hash, "WITH h AS (SELECT c_name, row_number() OVER (ORDER BY sha1(c_name || '|3'), c_name) AS r, count(*) OVER () AS n FROM customer), s AS (SELECT c_name, CASE WHEN r <= round_even(n * 0.2::DOUBLE, 0) THEN 'CAL' WHEN r > n - round_even(n * 0.25::DOUBLE, 0) THEN 'EVAL' ELSE 'POOL' END AS bench_split FROM h) SELECT c_name, bench_split, CASE bench_split WHEN 'CAL' THEN 'V' WHEN 'POOL' THEN 'T' ELSE 'P' END AS engine_split FROM s"),
    "links": (links, f"WITH {FRAMES_SQL} SELECT event_id::VARCHAR AS token, coalesce((lag(event_id) OVER w)::VARCHAR, '') AS prev, coalesce((lead(event_id) OVER w)::VARCHAR, '') AS next FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)"),
    "keyframes": (keyframes, f"WITH {FRAMES_SQL}, i AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i FROM f) SELECT event_id, i % 5 = 0 AS is_key_frame, (i // 5)::INTEGER AS sample_idx FROM i"),
    "instance_speed": (instance_speed, f"WITH {FRAMES_SQL}, n AS (SELECT event_id, coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t) AS dt, coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value) AS dx FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT event_id, CASE WHEN dt > 0 THEN round_even(sqrt(dx * dx + dx / 2 * dx / 2) / (dt / 1e6), 6) END AS speed FROM n"),
    "label_oracle_order": (label_oracle_order, f"WITH {ORDERS_SQL} SELECT sample_token, floor(o_totalprice / 50000)::BIGINT AS n_cells FROM fr ORDER BY scene_desc = '1-URGENT' DESC, CASE WHEN scene_desc = '1-URGENT' THEN -floor(o_totalprice / 50000) END, CASE WHEN scene_desc <> '1-URGENT' THEN sha1(sample_token || '|2') END, sample_token LIMIT 60"),
    "budget_prefix": (budget_prefix, f"WITH {ORDERS_SQL}, r AS (SELECT sample_token, row_number() OVER (ORDER BY o_totalprice DESC, sample_token) AS rank, count(*) OVER () AS n FROM fr) SELECT sample_token, rank FROM r WHERE rank <= greatest(1, ceil(round_even(n * 0.07::DOUBLE, 9)))"),
    "shape_score": (shape_expression, _B + " SELECT sample_token, object_id, round_even(1 - exp(-0.5 * greatest(((l - 1.5::DOUBLE) / 0.4::DOUBLE) ** 2, ((w - 0.7::DOUBLE) / 0.2::DOUBLE) ** 2)), 6) AS shape FROM b"),
    "frame_positions": (frame_positions, "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS frame_idx FROM orders"),
}

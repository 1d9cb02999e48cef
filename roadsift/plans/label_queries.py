"""Queries of labels, LiDAR frames, projection, fusion and judge statistics over the stand-in tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import pixel
from ..functions.ranks import bround6
from ..functions.scalars import arg_max, size_class, softmax, top2_margin
from ..operators import context as ctx
from ..operators import evaluation as ev
from ..operators import labels as lab
from ..operators import scoring as sc
from ..operators.joins import left_with_zero
from ..operators.pointcloud import points_in_boxes
from .frames import OBJECTS_SQL, objects
from .score_queries import BOXES_SQL, ORDERS_SQL, boxes, order_frames


def surprisal_frame_labels(spark, d):
    """Frame labels from surprisals fitted on the split V."""
    b = boxes(spark, d).select("sample_token", F.col("track_id").alias("instance_token"), F.col("cls_pred").alias("vru_group"), "dist_m", F.col("pts").alias("num_lidar_pts"))
    return lab.surprisal_labels(b, order_frames(spark, d))


def _v_edges(v: str) -> str:
    return " UNION ".join(f"SELECT cls_pred, v[ceil((len(v) - 1) * {q}::DOUBLE)::BIGINT + 1] AS e FROM (SELECT cls_pred, list({v} ORDER BY {v}) AS v FROM sv GROUP BY 1)" for q in (0.25, 0.5, 0.75))


LABEL_SQL = f"""
WITH {BOXES_SQL}, {ORDERS_SQL},
se AS (SELECT b.*, split FROM b JOIN fr USING (sample_token) WHERE pts >= 1), sv AS (SELECT * FROM se WHERE split = 'V'),
cl AS (SELECT cls_pred, count(DISTINCT track_id) / (SELECT count(DISTINCT track_id) FROM sv) AS class_p FROM sv GROUP BY 1),
ed AS ({_v_edges('dist_m')}), ep AS ({_v_edges('pts')}),
ce AS (SELECT se.*, cls_pred || '|d' || (SELECT count(*) FROM ed WHERE ed.cls_pred = se.cls_pred AND e <= dist_m) || '|p' || (SELECT count(*) FROM ep WHERE ep.cls_pred = se.cls_pred AND e <= pts) AS cell FROM se),
cp AS (SELECT cell, count(DISTINCT sample_token) / (SELECT count(*) FROM fr WHERE split = 'V') AS cell_p FROM ce WHERE split = 'V' GROUP BY 1),
wo AS (SELECT sample_token, max(-ln(class_p)) AS u1, max(-ln(cell_p)) AS u2, bool_or(class_p IS NULL OR cell_p IS NULL) AS un, count(*) AS n FROM ce LEFT JOIN cl USING (cls_pred) LEFT JOIN cp USING (cell) GROUP BY 1),
ba AS (SELECT sample_token, split, coalesce(u1, 0) AS u1, coalesce(u2, 0) AS u2, coalesce(un, false) AS unknown, coalesce(n, 0) AS n FROM fr LEFT JOIN wo USING (sample_token)),
th AS (SELECT (list(u1 ORDER BY u1))[ceil((count(*) - 1) * 0.9::DOUBLE)::BIGINT + 1] AS t1, (list(u2 ORDER BY u2))[ceil((count(*) - 1) * 0.9::DOUBLE)::BIGINT + 1] AS t2 FROM ba WHERE split = 'V')
SELECT sample_token, split, u1 > t1 AS r1_class, u2 > t2 AS r2_combo, unknown, n::BIGINT AS n_vru_visible, u2 > t2 AS is_target FROM ba, th
"""


def lidar_frame_scores(spark, d):
    """Ranks of rarity, novelty and uncertainty on kept frames and their weighted sum."""
    f = order_frames(spark, d).select("sample_token", (F.col("o_orderstatus") != "P").alias("keep"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("rar"), (F.col("sample_token") * 7 % 1000).cast("double").alias("nov"), (F.col("sample_token") % 97).cast("double").alias("unc"))
    return sc.lidar_scores(f, (0.5, 0.3, 0.2)).select("sample_token", "keep", "s", *[bround6(F.col(f"r_{c}")).alias(f"r_{c}") for c in ("rar", "nov", "unc")])


def _rank_sql(x: str) -> str:
    return f"CASE WHEN keep THEN ((rank() OVER (PARTITION BY keep ORDER BY {x}) + (count(*) OVER (PARTITION BY keep, {x}) - 1) / 2.0) / count(*) OVER (PARTITION BY keep))::DOUBLE ELSE 0.0 END AS r_{x}"


LIDAR_SQL = f"""
WITH {ORDERS_SQL}, f AS (SELECT sample_token, o_orderstatus <> 'P' AS keep, floor(o_totalprice / 1000) AS rar, sample_token * 7 % 1000 AS nov, sample_token % 97 AS unc FROM fr),
r AS (SELECT sample_token, keep, {_rank_sql('rar')}, {_rank_sql('nov')}, {_rank_sql('unc')} FROM f)
SELECT sample_token, keep, round_even(CASE WHEN keep THEN 0.5::DOUBLE * r_rar + 0.3::DOUBLE * r_nov + 0.2::DOUBLE * r_unc ELSE 0 END, 6) AS s, round_even(r_rar, 6) AS r_rar, round_even(r_nov, 6) AS r_nov, round_even(r_unc, 6) AS r_unc FROM r
"""


def _points(spark, d):
    return objects(spark, d, ["l_quantity", "l_discount", "l_tax"]).select(F.col("l_orderkey").alias("sample_token"), (F.col("l_quantity") - 25).alias("x"), (F.floor(F.col("l_discount") * 100 + 1e-9) - 5).alias("y"), (F.floor(F.col("l_tax") * 100 + 1e-9) / 4).alias("z"))


_POINTS = f"{OBJECTS_SQL}, pt AS (SELECT l_orderkey AS sample_token, l_quantity - 25 AS x, floor(l_discount * 100 + 1e-9) - 5 AS y, floor(l_tax * 100 + 1e-9) / 4 AS z FROM o)"


def lidar_keep(spark, d):
    """Points left without the vehicle's own returns, and whether a sweep is kept."""
    return sc.keep_frames(_points(spark, d), close=3.0, least=4)


KEEP_SQL = f"""
WITH {_POINTS}, c AS (SELECT sample_token, count(*) FILTER (NOT (abs(x) < 3 AND abs(y) < 3)) AS n FROM pt GROUP BY 1)
SELECT sample_token, n AS n_points, n >= 4 AS keep, CASE WHEN n < 4 THEN 'few_points' ELSE '' END AS reason FROM c
"""


def box_points(spark, d):
    """Points inside every rotated box of the frame."""
    p = _points(spark, d)
    o = objects(spark, d, ["l_quantity", "l_discount"]).select(
        F.col("l_orderkey").alias("sample_token"), F.col("l_linenumber").alias("box"), (F.col("l_quantity") - 25).alias("cx"), (F.floor(F.col("l_discount") * 100 + 1e-9) - 5).alias("cy"), F.lit(1.0).alias("cz"),
        F.lit(18.5).alias("l"), F.lit(7.3).alias("w"), F.lit(1.9).alias("h"), (F.col("l_linenumber") * 0.35).alias("yaw"),
    )
    return points_in_boxes(p, o, "sample_token", "box")


BOX_SQL = f"""
WITH {_POINTS}, bx AS (SELECT l_orderkey AS sample_token, l_linenumber AS box, l_quantity - 25 AS cx, floor(l_discount * 100 + 1e-9) - 5 AS cy, l_linenumber * 0.35::DOUBLE AS yaw FROM o)
SELECT sample_token, box, count(*) FILTER (abs((x - cx) * cos(yaw) + (y - cy) * sin(yaw)) <= 9.25::DOUBLE + 1e-6 AND abs((y - cy) * cos(yaw) - (x - cx) * sin(yaw)) <= 3.65::DOUBLE + 1e-6 AND abs(z - 1) <= 0.95::DOUBLE + 1e-6) AS n_inside
FROM bx JOIN pt USING (sample_token) GROUP BY 1, 2
"""

_K = (1266.4, 0.0, 816.3, 0.0, 1266.4, 491.5, 0.0, 0.0, 1.0)


def pinhole_pixels(spark, d):
    """Pixel and depth of every object through a pinhole camera; none at depth 0."""
    p = F.array(F.col("cx"), F.col("cy"), F.col("dist_m") - 20)
    out = boxes(spark, d).select("sample_token", "object_id", pixel(p, F.array(*[F.lit(x) for x in _K])).alias("p"))
    return out.select("sample_token", "object_id", *[bround6(F.col("p")[k]).alias(n) for k, n in enumerate(("u", "v", "depth"))])


PIXEL_SQL = f"""
WITH {BOXES_SQL}, q AS (SELECT *, dist_m - 20 AS z FROM b)
SELECT sample_token, object_id, CASE WHEN z <> 0 THEN round_even(({_K[0]}::DOUBLE * cx + {_K[2]}::DOUBLE * z) / z, 6) END AS u, CASE WHEN z <> 0 THEN round_even(({_K[4]}::DOUBLE * cy + {_K[5]}::DOUBLE * z) / z, 6) END AS v, round_even(z, 6) AS depth FROM q
"""


def softmax_margins(spark, d):
    """Class probabilities of three signals, their winner and its margin."""
    x = F.array(F.col("dist_m") / 10, F.col("pts").cast("double") / 4, F.col("cx") / 8)
    out = boxes(spark, d).select("sample_token", "object_id", softmax(x).alias("p"))
    return out.select("sample_token", "object_id", arg_max(F.col("p")).alias("best"), bround6(top2_margin(F.col("p"))).alias("margin"))


SOFTMAX_SQL = f"""
WITH {BOXES_SQL}, x AS (SELECT sample_token, object_id, [dist_m / 10, pts / 4, cx / 8]::DOUBLE[] AS x FROM b),
e AS (SELECT *, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM x),
p AS (SELECT *, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e)
SELECT sample_token, object_id, (list_position(p, list_max(p)) - 1)::INTEGER AS best, round_even(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 6) AS margin FROM p
"""

_SIZES = (("small", 1.2, 0.7, 1.0, 1.5), ("flat", 1.6, 0.9, 1.0, 1.4), ("tall", 2.0, 1.0, 1.5, 2.1))


def size_classes(spark, d):
    """Classes by the first size rule that holds."""
    return boxes(spark, d).select("sample_token", "object_id", size_class(F.col("l"), F.col("w"), F.col("h"), _SIZES).alias("cls"))


SIZE_SQL = f"WITH {BOXES_SQL} SELECT sample_token, object_id, CASE " + " ".join(f"WHEN greatest(l, w) <= {a}::DOUBLE AND least(l, w) <= {c}::DOUBLE AND h BETWEEN {lo}::DOUBLE AND {hi}::DOUBLE THEN '{n}'" for n, a, c, lo, hi in _SIZES) + " ELSE 'other' END AS cls FROM b"


def semantic_fusion(spark, d):
    """Object scores fused with a semantic rank or a concept hit; the reason changes where semantics leads."""
    b = boxes(spark, d).withColumns({"s_obj": F.col("dist_m") / 60, "reasons": F.concat(F.lit("slice of "), "cls_pred")})
    s = b.filter("pts > 6").select("sample_token", "object_id", (F.col("pts") / 25).alias("r_sem"), F.lit("").alias("concept_top"), F.when(F.col("dist_m") > 30, F.lit(0.75)).alias("concept_score"))
    return sc.fuse_semantic(b, s).select("sample_token", "object_id", bround6(F.col("s_obj")).alias("s_obj"), "reasons")


FUSION_SQL = f"""
WITH {BOXES_SQL}, s AS (SELECT sample_token, object_id, dist_m / 60 AS s, 'slice of ' || cls_pred AS r, CASE WHEN pts > 6 THEN greatest(pts / 25, CASE WHEN dist_m > 30 THEN 0.75::DOUBLE ELSE 0 END) END AS m FROM b)
SELECT sample_token, object_id, round_even(CASE WHEN m IS NULL THEN s ELSE 0.7::DOUBLE * s + 0.3::DOUBLE * m END, 6) AS s_obj, CASE WHEN m > s THEN 'semantic p' || round_even(m * 100, 0)::INTEGER ELSE r END AS reasons FROM s
"""


def _contexts(spark, d):
    """Objects as camera images with context tags."""
    tags = {"A": ("night", "dry"), "N": ("day", "rain"), "R": ("lowlight", "fog")}
    pick = lambda k: F.create_map(*[F.lit(x) for f, v in tags.items() for x in (f, v[k])])[F.col("l_returnflag")]
    cam = F.when(F.col("l_linenumber") == 1, F.lit("CAM_FRONT")).otherwise(F.concat(F.lit("CAM_"), F.col("l_linenumber").cast("string")))
    return objects(spark, d).select(
        F.col("l_orderkey").alias("sample_token"), cam.alias("cam"), pick(0).alias("tag_illum"), F.when(F.col("l_quantity") > 5, pick(1)).alias("tag_weather"), F.when(F.col("l_discount") > 0.05, F.lit("glare_sun")).otherwise(F.lit("none")).alias("tag_glare"),
        F.when(F.col("l_tax") > 0.06, F.lit("dirty")).otherwise(F.lit("clean")).alias("tag_lens"), (F.col("l_linestatus") == "O").alias("review"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("sun_elev_deg"),
    )


_CONTEXT = f"""{OBJECTS_SQL}, im AS (
  SELECT l_orderkey AS sample_token, CASE WHEN l_linenumber = 1 THEN 'CAM_FRONT' ELSE 'CAM_' || l_linenumber END AS cam, CASE l_returnflag WHEN 'A' THEN 'night' WHEN 'N' THEN 'day' ELSE 'lowlight' END AS illum,
         CASE WHEN l_quantity > 5 THEN CASE l_returnflag WHEN 'A' THEN 'dry' WHEN 'N' THEN 'rain' ELSE 'fog' END END AS weather, l_discount > 0.05 AS glare, l_tax > 0.06 AS dirty, l_linestatus = 'O' AS review,
         CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS sun FROM o)"""


def context_summary(spark, d):
    """Distinct frames under each context."""
    return ctx.context_summary(_contexts(spark, d))


SUMMARY_SQL = f"""
WITH {_CONTEXT} SELECT count(DISTINCT sample_token) FILTER (illum = 'night') AS night, count(DISTINCT sample_token) FILTER (illum = 'lowlight') AS lowlight, count(DISTINCT sample_token) FILTER (glare) AS glare,
       count(DISTINCT sample_token) FILTER (dirty) AS bad_lens, count(DISTINCT sample_token) FILTER (weather <> 'dry') AS bad_weather, count(DISTINCT sample_token) FILTER (review) AS review FROM im
"""


def context_frames(spark, d):
    """Context of a frame: the front camera's weather, else the majority of bad weather; the first known sun."""
    return ctx.frame_context(_contexts(spark, d))


CONTEXT_SQL = f"""
WITH {_CONTEXT}, bad AS (SELECT sample_token, weather, count(*) AS n FROM im WHERE weather <> 'dry' GROUP BY 1, 2),
m AS (SELECT sample_token, weather AS often FROM bad QUALIFY row_number() OVER (PARTITION BY sample_token ORDER BY n DESC, weather) = 1),
p AS (SELECT sample_token, max(weather) FILTER (cam = 'CAM_FRONT') AS front, count(*) FILTER (weather <> 'dry') AS n_bad, count(weather) AS n_tags, arg_min(sun, cam) FILTER (sun IS NOT NULL) AS sun_elev_deg FROM im GROUP BY 1)
SELECT p.sample_token, coalesce(front, CASE WHEN n_bad * 2 > n_tags THEN often END, '') AS weather_pred, sun_elev_deg FROM p LEFT JOIN m ON m.sample_token = p.sample_token
"""


def subsample_recall_ci(spark, d):
    """Interval of recall from subsamples of half the scenes without replacement."""
    f = order_frames(spark, d).select((F.col("scene_token") % 50).alias("k"), (F.col("o_totalprice") > 200000).alias("hit"), (F.col("o_orderstatus") == "F").alias("rare"))
    return ev.subsample_ci(f, "k", "hit", "rare", 100, 0.5, 3).select(*[bround6(F.col(c)).alias(c) for c in ("mean", "low", "high")])


SUBSAMPLE_SQL = f"""
WITH {ORDERS_SQL}, s AS (SELECT scene_token % 50 AS k, count(*) FILTER (o_totalprice > 200000 AND o_orderstatus = 'F') AS h, count(*) FILTER (o_orderstatus = 'F') AS r FROM fr GROUP BY 1),
e AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY md5('3|' || b || '|' || k), k) AS n FROM s, (SELECT unnest(range(0, 100)) AS b)),
v AS (SELECT b, sum(h) / greatest(sum(r), 1) AS x FROM e WHERE n <= greatest(1, round_even((SELECT count(*) FROM s) * 0.5::DOUBLE, 0)) GROUP BY 1)
SELECT round_even(avg(x), 6) AS mean, round_even(quantile_cont(x, 0.025), 6) AS low, round_even(quantile_cont(x, 0.975), 6) AS high FROM v
"""


def judge_validity(spark, d):
    """Whether a judge's scores part easy from hard objects."""
    o = boxes(spark, d).select((F.col("dist_m") / 50).alias("score"), (F.col("dist_m") < 20).alias("struggle"), "pts")
    out = ev.judge_validity(o, "score", "struggle", F.col("pts") >= 12, F.col("pts") < 6, 0.5, 1.0)
    return out.select(*[bround6(F.col(c)).alias(c) for c in ("easy_recall", "ratio", "auroc")], "valid")


JUDGE_SQL = f"""
WITH {BOXES_SQL}, jo AS (SELECT dist_m / 50 AS score, dist_m < 20 AS st, pts >= 12 AS easy, pts < 6 AS hard FROM b),
a AS (SELECT avg((NOT st)::INT) FILTER (easy) AS er, avg(st::INT) FILTER (easy) AS se, avg(st::INT) FILTER (hard) AS sh FROM jo),
r AS (SELECT hard, rank() OVER (ORDER BY 1 - score) + (count(*) OVER (PARTITION BY 1 - score) - 1) / 2.0::DOUBLE AS r FROM jo WHERE easy OR hard),
u AS (SELECT (sum(r) FILTER (hard) - count(*) FILTER (hard) * (count(*) FILTER (hard) + 1) / 2) / (count(*) FILTER (hard) * count(*) FILTER (NOT hard)) AS auc FROM r)
SELECT round_even(er, 6) AS easy_recall, round_even(sh / se, 6) AS ratio, round_even(auc, 6) AS auroc, er >= 0.5 AND sh / se >= 1.0 AND auc > 0.5 AS valid FROM a, u
"""


def zero_filled_join(spark, d):
    """Detections joined onto frames: 0 where a frame has none."""
    dets = boxes(spark, d).filter("pts > 15").groupBy("sample_token").agg(F.count(F.lit(1)).alias("det_n"), F.sum("pts").alias("det_pts"))
    return left_with_zero(order_frames(spark, d).select("sample_token", "split"), dets, ["sample_token"])


ZERO_SQL = f"WITH {BOXES_SQL}, {ORDERS_SQL}, d AS (SELECT sample_token, count(*) AS n, sum(pts)::BIGINT AS p FROM b WHERE pts > 15 GROUP BY 1) SELECT fr.sample_token, split, coalesce(n, 0) AS det_n, coalesce(p, 0)::BIGINT AS det_pts FROM fr LEFT JOIN d USING (sample_token)"

QUERIES = {
    "surprisal_frame_labels": (surprisal_frame_labels, LABEL_SQL),
    "lidar_frame_scores": (lidar_frame_scores, LIDAR_SQL),
    "lidar_keep": (lidar_keep, KEEP_SQL),
    "box_points": (box_points, BOX_SQL),
    "pinhole_pixels": (pinhole_pixels, PIXEL_SQL),
    "softmax_margins": (softmax_margins, SOFTMAX_SQL),
    "size_classes": (size_classes, SIZE_SQL),
    "semantic_fusion": (semantic_fusion, FUSION_SQL),
    "context_summary": (context_summary, SUMMARY_SQL),
    "context_frames": (context_frames, CONTEXT_SQL),
    "subsample_recall_ci": (subsample_recall_ci, SUBSAMPLE_SQL),
    "judge_validity": (judge_validity, JUDGE_SQL),
    "zero_filled_join": (zero_filled_join, ZERO_SQL),
}

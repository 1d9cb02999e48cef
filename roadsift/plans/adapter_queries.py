"""Queries of motion, source preference, training sets, baseline selectors, pages and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranks import bround6, with_row_number
from ..functions.scalars import scene_range
from ..operators import adapters as ad
from ..operators import aggregates as agg
from ..operators import evaluation as ev
from ..operators.joins import many_to_one, only, without
from ..plans import views
from .frames import FRAMES_SQL, OBJECTS_SQL, frames, objects, table
from .score_queries import BOXES_SQL, ORDERS_SQL, boxes, order_frames


def _track(spark, d):
    return frames(spark, d).select(F.col("user_id").alias("log"), "event_id", (F.col("t") / 3.6e9).alias("t"), F.col("value").alias("x"), (F.col("value") * F.col("value") / 50).alias("y"))


def ego_motion(spark, d):
    m = ad.ego_motion(_track(spark, d))
    return m.select("event_id", bround6(F.col("heading")).alias("heading"), "moving")


_TRACK_SQL = f"{FRAMES_SQL}, p AS (SELECT user_id AS log, event_id, t / 3.6e9::DOUBLE AS t, value AS x, value * value / 50 AS y FROM f)"


def track_heading_errors(spark, d):
    t = _track(spark, d).withColumns({"uuid": F.col("log"), "yaw": F.col("x") / 10})
    return ad.track_heading_errors(t, least_speed=0.5, most_dt=200.0).select("uuid", bround6(F.col("t")).alias("t"), bround6(F.col("error_deg")).alias("error_deg"))


def prefer_source(spark, d):
    o = objects(spark, d).select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("uuid"), (F.col("l_linenumber") % 3 - 1).alias("sensor_id"))
    return ad.prefer_source(o).select("l_orderkey", "l_linenumber")


def train_set(spark, d):
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_token"), F.lit("c").alias("cam"), F.col("o_orderkey").cast("string").alias("img_path"))
    b = objects(spark, d).select(F.col("l_orderkey").alias("sample_token"), F.lit("c").alias("cam"), F.concat(F.lit("k."), F.col("l_returnflag")).alias("category"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("l_quantity").alias("x2"), (F.col("l_discount") * 200).alias("y2"))
    out = ad.train_set(f, b, {"k.A": 1, "k.N": 2})
    return out.select("img_path", F.size("boxes").alias("n"), F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


def rival_features(spark, d):
    o = objects(spark, d)
    img = o.select(F.col("l_orderkey").alias("sample_token"), F.col("l_quantity").alias("q_blur"), F.col("l_extendedprice").alias("q_bright"))
    unc = o.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("sample_token"), F.col("l_tax").alias("unc"))
    det = o.select(F.col("l_orderkey").alias("sample_token"), (F.col("l_linenumber") % 5).alias("cls"), (F.col("l_quantity") / 50).alias("conf"))
    return ad.rival_features(img, unc, det).select("sample_token", "q_blur_min", bround6(F.col("q_bright_mean")).alias("q_bright_mean"), "unc_max", "vru_count")


def rival_crowd(spark, d):
    o = objects(spark, d).groupBy(F.col("l_orderkey").alias("sample_token")).agg(F.count(F.lit(1)).alias("vru_count"))
    return ad.rival(o, "crowd", 50)


def page_of_frames(spark, d):
    ranked = with_row_number(order_frames(spark, d).select("sample_token", "o_totalprice", "o_orderstatus", "scene_desc"), [F.desc("o_totalprice"), F.col("sample_token")], "rank")
    f = ranked.select(F.col("sample_token").cast("string").alias("sample_token"), "rank", F.concat_ws("|", "o_orderstatus", F.substring("scene_desc", 1, 3)).alias("pred_tags"), F.lit(True).alias("selected"))
    return views.frame_page(f, 20, 30, tag="1-").select("sample_token", F.col("rank").cast("long").alias("rank"))


def duplicate_tags(spark, d):
    f = frames(spark, d).select("event_id", (F.col("event_id") % 2500).alias("group"), F.col("event_id").alias("rank"))
    return views.duplicate_tags(f).select("event_id", "duplicate_of_rank")


def class_stats(spark, d):
    return agg.class_stats(boxes(spark, d), "cls_pred", ["l", "w"]).select("cls_pred", *[bround6(F.col(c)).alias(c) for c in ("l_median", "l_std", "w_median", "w_std")])


def zero_filled_counts(spark, d):
    return agg.zero_filled_counts(boxes(spark, d), "cls_pred", ["pedestrian", "bicycle", "motorcycle", "other"])


def semi_and_anti(spark, d):
    o, c = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    return only(o, c, "k").agg(F.count(F.lit(1)).alias("n_only")).crossJoin(without(o, c, "k").agg(F.count(F.lit(1)).alias("n_without")))


def checked_many_to_one(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    met = many_to_one(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"])
    return met.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def matched_detections(spark, d):
    o = objects(spark, d)
    det = o.filter("l_returnflag = 'A'").select("l_orderkey", F.col("l_linenumber").alias("det_id"), F.col("l_quantity").alias("p"))
    gt = o.filter("l_returnflag = 'R'").select("l_orderkey", F.col("l_quantity").alias("g"))
    return ev.matched_detections(det, gt, ["l_orderkey"], -F.abs(F.col("p") - F.col("g")), -5.0)


def struggle_yield(spark, d):
    b = boxes(spark, d).select("sample_token", F.col("track_id").alias("inst"), (F.col("dist_m") > 40).alias("struggle"), (F.col("dist_m") / 50).alias("unc"))
    sel = order_frames(spark, d).orderBy(F.desc("o_totalprice"), "sample_token").limit(80)
    out = ev.struggle_yield(b, sel, "sample_token", "inst", "struggle", "unc")
    return out.select(*[bround6(F.col(c)).alias(c) for c in ("sy", "unc", "empty_rate")])


def bootstrap_p_value(spark, d):
    x = frames(spark, d).select((F.col("event_id") % 5).alias("m"), (F.col("value") - 12).alias("delta"))
    return ev.bootstrap_p(x, "delta", ["m"]).select("m", bround6(F.col("p")).alias("p"))


def scene_ranges(spark, d):
    r = table(spark, d, "region").select("r_regionkey", F.concat(F.col("r_regionkey").cast("string"), F.lit(".."), (F.col("r_regionkey") + 2).cast("string"), F.lit(", 9")).alias("spec"))
    return r.select("r_regionkey", F.explode(scene_range(F.col("spec"))).alias("scene"))


_W = "WINDOW w AS (PARTITION BY log ORDER BY t)"
QUERIES = {
    "ego_motion": (ego_motion, f"WITH {_TRACK_SQL}, v AS (SELECT event_id, (coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x)) / (coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t)) AS vx, (coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y)) / (coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t)) AS vy FROM p {_W}) SELECT event_id, round_even(atan2(vy, vx), 6) AS heading, sqrt(vx * vx + vy * vy) > 1 AS moving FROM v"),
    "track_heading_errors": (track_heading_errors, f"WITH {_TRACK_SQL}, v AS (SELECT log, t, x / 10 AS yaw, t - lag(t) OVER w AS dt, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM p {_W}), a AS (SELECT log, t, atan2(dy, dx) - yaw AS a FROM v WHERE dt < 200 AND sqrt(dx ** 2 + dy ** 2) / greatest(dt, 1e-9) > 0.5), m AS (SELECT log, t, a - floor(a / pi()) * pi() AS a FROM a) SELECT log AS uuid, round_even(t, 6) AS t, round_even(degrees(least(a, pi() - a)), 6) AS error_deg FROM m"),
    "prefer_source": (prefer_source, f"WITH {OBJECTS_SQL}, s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 3 - 1 AS k FROM o) SELECT l_orderkey, l_linenumber FROM s WHERE NOT (k = 1 AND l_partkey IN (SELECT l_partkey FROM s WHERE k IN (-1, 0)))"),
    "train_set": (train_set, f"WITH {OBJECTS_SQL}, g AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 1 ELSE 2 END AS k, l_quantity AS q, l_discount * 200 AS y FROM o WHERE l_returnflag <> 'R' AND l_discount * 200 >= 8 AND l_quantity > 0), a AS (SELECT l_orderkey, count(*) AS n, string_agg(k::VARCHAR, ',' ORDER BY q, y, k) AS s FROM g GROUP BY 1) SELECT o_orderkey::VARCHAR AS img_path, coalesce(n, 0)::INTEGER AS n, coalesce(s, '') AS labels FROM orders LEFT JOIN a ON l_orderkey = o_orderkey"),
    "rival_features": (rival_features, f"WITH {OBJECTS_SQL} SELECT l_orderkey AS sample_token, min(l_quantity) AS q_blur_min, round_even(avg(l_extendedprice), 6) AS q_bright_mean, coalesce(max(l_tax) FILTER (l_linestatus = 'F'), 0.0) AS unc_max, count(*) FILTER (l_quantity / 50 >= 0.5 AND l_linenumber % 5 IN (0, 1, 3)) AS vru_count FROM o GROUP BY 1"),
    "rival_crowd": (rival_crowd, f"WITH {OBJECTS_SQL} SELECT l_orderkey AS sample_token, count(*) AS vru_count FROM o GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"),
    "frame_page": (page_of_frames, f"WITH {ORDERS_SQL}, r AS (SELECT sample_token, row_number() OVER (ORDER BY o_totalprice DESC, sample_token) AS rank, scene_desc FROM fr) SELECT sample_token::VARCHAR AS sample_token, rank FROM r WHERE starts_with(scene_desc, '1-') ORDER BY rank LIMIT 30 OFFSET 20"),
    "duplicate_tags": (duplicate_tags, "SELECT event_id, CASE WHEN count(*) OVER g > 1 AND event_id > min(event_id) OVER g THEN min(event_id) OVER g END AS duplicate_of_rank FROM events WINDOW g AS (PARTITION BY event_id % 2500)"),
    "class_stats": (class_stats, f"WITH {BOXES_SQL} SELECT cls_pred, round_even(median(l), 6) AS l_median, round_even(greatest(stddev_pop(l), 0.05), 6) AS l_std, round_even(median(w), 6) AS w_median, round_even(greatest(stddev_pop(w), 0.05), 6) AS w_std FROM b GROUP BY 1"),
    "zero_filled_counts": (zero_filled_counts, f"WITH {BOXES_SQL} SELECT k.c AS cls_pred, count(b.cls_pred) AS n FROM (SELECT unnest(['pedestrian', 'bicycle', 'motorcycle', 'other']) AS c) k LEFT JOIN b ON b.cls_pred = k.c GROUP BY 1"),
    "semi_and_anti": (semi_and_anti, "SELECT count(*) FILTER (c_custkey IS NOT NULL) AS n_only, count(*) FILTER (c_custkey IS NULL) AS n_without FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey = o_custkey"),
    "checked_many_to_one": (checked_many_to_one, "SELECT c_mktsegment, count(*) AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1"),
    "matched_detections": (matched_detections, f"WITH {OBJECTS_SQL} SELECT DISTINCT a.l_orderkey, a.l_linenumber AS det_id FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'R' AND abs(a.l_quantity - b.l_quantity) <= 5"),
    "struggle_yield": (struggle_yield, f"WITH {BOXES_SQL}, {ORDERS_SQL}, s AS (SELECT sample_token FROM fr ORDER BY o_totalprice DESC, sample_token LIMIT 80), m AS (SELECT s.sample_token, track_id, dist_m FROM s LEFT JOIN b USING (sample_token)), e AS (SELECT sample_token, count(track_id) AS n FROM m GROUP BY 1) SELECT round_even(count(DISTINCT track_id) FILTER (dist_m > 40) / 80, 6) AS sy, round_even(avg(dist_m / 50), 6) AS unc, round_even((SELECT avg((n = 0)::INT) FROM e), 6) AS empty_rate FROM m"),
    "bootstrap_p": (bootstrap_p_value, "SELECT event_id % 5 AS m, round_even(least(1.0, 2 * least(avg((value <= 12)::INT), avg((value >= 12)::INT))), 6) AS p FROM events GROUP BY 1"),
    "scene_ranges": (scene_ranges, "SELECT r_regionkey, 'scene-' || lpad(n::VARCHAR, 4, '0') AS scene FROM (SELECT r_regionkey, unnest(list_append(range(r_regionkey, r_regionkey + 3), 9)) AS n FROM region)"),
}

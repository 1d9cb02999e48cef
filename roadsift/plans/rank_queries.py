"""Queries of contracts, ranks, joins in time, aggregates and histograms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.ranks import bround6, pct_rank, with_group_pct_rank, with_pct_rank
from ..functions.scalars import binary_entropy, bin_right, has_keyword, json_field, pipe_join, pipe_split, relative_change, slug
from ..operators import aggregates as agg
from ..operators.joins import asof_last, asof_nearest, chain_walk, previous_value
from ..operators.selection import minmax_score, random_k_quota, top_k, top_k_quota
from .frames import FRAMES_SQL, OBJECTS_SQL, frames, objects, table

def _rank_sql(x: str, part: str = "") -> str:
    p = f"PARTITION BY {part}" if part else ""
    tie = f"PARTITION BY {part}, {x}" if part else f"PARTITION BY {x}"
    return f"((rank() OVER ({p} ORDER BY {x}) + (count(*) OVER ({tie}) - 1) / 2.0) / count(*) OVER ({p}))::DOUBLE"


def frame_topk_quota(spark, d):
    """The 5 % of frames with the best weighted percentile ranks of value and change, at most 3 a scene."""
    f = frames(spark, d)
    change = previous_value(F.col("value"), ["user_id"], "frame_idx")
    f = f.withColumn("change", F.when(change.isNull(), F.lit(0.0)).otherwise(relative_change(F.col("value"), change)))
    f = with_pct_rank(with_pct_rank(f, "value", "r_val"), "change", "r_chg").withColumn("s", bround6(0.6 * F.col("r_val") + 0.4 * F.col("r_chg")))
    budget = max(1, -(-table(spark, d, "events").count() * 5 // 100))
    return top_k_quota(f, "s", "user_id", "event_id", budget, 3).select("event_id", "user_id", "s", F.col("scene_rank").cast("long").alias("scene_rank"))


FRAME_TOPK_SQL = f"""
WITH {FRAMES_SQL},
c AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER w = 1 THEN abs(value - lag(value) OVER w) / greatest(value, lag(value) OVER w, 1.0) ELSE 0.0 END AS change FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx)),
r AS (SELECT *, {_rank_sql('value')} AS r_val, {_rank_sql('change')} AS r_chg FROM c),
s AS (SELECT event_id, user_id, round_even(0.6::DOUBLE * r_val + 0.4::DOUBLE * r_chg, 6) AS s FROM r),
q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id) AS scene_rank FROM s)
SELECT event_id, user_id, s, scene_rank FROM q WHERE scene_rank <= 3
ORDER BY s DESC, event_id LIMIT (SELECT greatest(1, (count(*) * 5 + 99) // 100) FROM events)
"""


def contract_profile(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    key = ["l_orderkey", "l_linenumber"]
    dup = l.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("dup_rows"))
    return l.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("l_quantity").isNull()).alias("null_quantity"), F.count_if(~F.col("l_returnflag").isin("A", "N", "R")).alias("bad_flag")).crossJoin(dup)


def latest_prev_change(spark, d):
    f = frames(spark, d)
    prev = previous_value(F.col("value"), ["user_id", "event_type"], "frame_idx")
    return f.select("event_id", F.when(prev.isNull(), F.lit(0.0)).otherwise(relative_change(F.col("value"), prev)).alias("det_tmp")).withColumn("det_tmp", bround6(F.col("det_tmp")))


def binary_entropy_by_frame(spark, d):
    o = objects(spark, d)
    p = F.col("l_discount") * 9 + 0.05
    return o.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("det_n"), bround6(F.avg(binary_entropy(p))).alias("det_ent"), F.count_if(p >= 0.5).alias("det_n_conf"))


def pct_rank_masked(spark, d):
    f = with_pct_rank(frames(spark, d).withColumn("keep", F.col("event_type") != "view").withColumn("v", F.floor("value")), "v", "r", "keep")
    return f.select("event_id", bround6(F.col("r")).alias("r"))


def pct_rank_by_split(spark, d):
    f = frames(spark, d).withColumn("split", F.when(F.col("user_id") % 4 == 0, F.lit("V")).otherwise(F.lit("P")))
    return with_group_pct_rank(f, "value", ["split"], "r", constant_is_zero=False).select("event_id", "split", bround6(F.col("r")).alias("r"))


def frame_best_image(spark, d):
    """Best object of each frame (price; lowest line on ties), any returned object, object count."""
    o = objects(spark, d)
    best = F.max(F.struct(F.col("l_extendedprice").alias("k"), (-F.col("l_linenumber")).alias("o"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("n"))).alias("b")
    return o.groupBy("l_orderkey").agg(best, F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.count(F.lit(1)).alias("n_objects")).select("l_orderkey", F.col("b.n").alias("best_line"), F.col("b.p").alias("best_part"), F.col("b.k").alias("best_price"), "any_returned", "n_objects")


def topk_desc_token(spark, d):
    return top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 25)


def random_hash_quota(spark, d):
    return random_k_quota(frames(spark, d).select("event_id", "user_id"), "user_id", "event_id", 40, 1, 7).select("event_id", "user_id")


def minmax_p1_p99_score(spark, d):
    f = frames(spark, d).withColumn("keep", F.col("event_type") != "view").withColumn("change", F.col("frame_idx").cast("double"))
    return minmax_score(f, [("value", 0.7), ("change", 0.3)], "keep").select("event_id", "s")


def percentile_linear(spark, d):
    found = agg.quantiles_linear(objects(spark, d, ["l_returnflag", "l_extendedprice"]), "l_returnflag", "l_extendedprice", {f"p{int(q * 100)}": q for q in (0.01, 0.2, 0.5, 0.97)})
    return found.select("l_returnflag", *[bround6(F.col(c)).alias(c) for c in found.columns[1:]])


def quantile_higher_by_class(spark, d):
    return agg.quantile_higher_ranked(objects(spark, d), ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.9, "q90")


def discrete_percentile(spark, d):
    return agg.discrete_percentile(objects(spark, d), ["l_linestatus"], "l_quantity", 0.25, "p25")


def hist_equal_width(spark, d):
    f = frames(spark, d).withColumn("x", F.least(F.col("value") / 100.0, F.lit(1.0)))
    return agg.equal_histogram(f, "x", 20)


def hist_unequal(spark, d):
    return agg.edge_histogram(objects(spark, d), "l_quantity", [0, 10, 20, 30, 40, 50])


def normalised_hist(spark, d):
    h = agg.normalised_histogram(objects(spark, d), ["l_returnflag"], "l_quantity", [5, 10, 20, 40])
    return h.select("l_returnflag", *[bround6(F.col("hist")[k]).alias(f"h{k}") for k in range(3)])


def bev_grid(spark, d):
    o = objects(spark, d).withColumns({"x": F.col("l_quantity") - 25, "y": F.col("l_discount") * 500 - 25})
    return agg.grid_counts(o, ["l_returnflag"], "x", "y", 5.0, 20.0).select("l_returnflag", "iy", "ix", "n", bround6(F.col("log_n")).alias("log_n"))


def voxel_first(spark, d):
    o = objects(spark, d)
    v = [F.floor(F.col("l_quantity") / 10).alias("vx"), F.floor(F.col("l_discount") * 50 + 1e-9).alias("vy")]
    return o.groupBy("l_returnflag", *v).agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("p")).select("l_returnflag", "vx", "vy", F.col("p.l_orderkey").alias("l_orderkey"), F.col("p.l_linenumber").alias("l_linenumber"))


def majority_mode(spark, d):
    return agg.majority(frames(spark, d), ["user_id"], "event_type", "mode_type")


def spaced_frames(spark, d):
    return agg.spaced_count(frames(spark, d).filter(F.col("value") > 10), "user_id", "frame_idx", 4, "n_spaced")


def temporal_redundancy(spark, d):
    f = frames(spark, d).filter(F.col("event_type") == "click")
    return f.select("event_id", agg.has_close_neighbour("t", ["user_id"], 3_600_000_000.0 * 24).alias("redundant"))


def asof_previous(spark, d):
    """Each click with the latest view of the same user at or before it."""
    f = frames(spark, d)
    views = f.filter(F.col("event_type") == "view").select("user_id", F.col("t").alias("vt"), F.col("event_id").alias("view_id"))
    return asof_last(f.filter(F.col("event_type") == "click").select("event_id", "user_id", "t"), views, ["user_id"], "t", "vt", "view_id", "view_id").select("event_id", "view_id")


def asof_nearest_query(spark, d):
    f = frames(spark, d)
    views = f.filter(F.col("event_type") == "view").select("user_id", F.col("t").alias("vt"), F.col("event_id").alias("view_id"))
    return asof_nearest(f.filter(F.col("event_type") == "click").select("event_id", "user_id", "t"), views, ["user_id"], "t", "vt", 86_400_000_000.0).select("event_id", "view_id")


def chain_walk_query(spark, d):
    """Turns of a conversation as a linked list, walked from the first."""
    c = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    w = Window.partitionBy("conv_id").orderBy("turn")
    token = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    nodes = c.select(token(F.col("turn")).alias("token"), F.when(F.lead("turn").over(w).isNotNull(), token(F.lead("turn").over(w))).alias("following"))
    starts = c.groupBy("conv_id").agg(F.min("turn").alias("turn")).select(token(F.col("turn")).alias("start"))
    return chain_walk(spark, nodes, starts, "token", "following", "start").select("first", "token", F.col("position").cast("long").alias("position"))


def keyword_flags(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", has_keyword(F.col("text"), ["license", "copyright"]).alias("night"), has_keyword(F.col("text"), ["worthless", "stupid"]).alias("rain"))


def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", json_field(F.col("props"), "$.k").cast("long").alias("k"))


def slug_query(spark, d):
    return table(spark, d, "part").select("p_partkey", slug(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("slug"))


def pipe_sets(spark, d):
    o = objects(spark, d).groupBy("l_orderkey").agg(pipe_join(F.array_sort(F.collect_set("l_returnflag"))).alias("tags"))
    return o.select("l_orderkey", "tags", F.size(pipe_split(F.col("tags"))).alias("n_tags"))


def right_bins(spark, d):
    return objects(spark, d).groupBy(bin_right(F.col("l_quantity"), [0.0, 5.0, 20.0, 100000.0], clip=True).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def cube_summary(spark, d):
    o = objects(spark, d)
    return o.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))


def pivot_status(spark, d):
    return objects(spark, d).groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)


def tumbling_hours(spark, d):
    return frames(spark, d).groupBy(F.floor(F.col("t") / F.lit(86_400_000_000)).alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(spark, d):
    """Sessions of a user split at gaps of a day."""
    f = frames(spark, d)
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    new = F.coalesce((F.col("t") - F.lag("t").over(w) > 86_400_000_000).cast("int"), F.lit(1))
    s = f.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("length_us"))


def union_runs(spark, d):
    from ..operators.selection import union_runs as union

    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return union([("top", 0, top_k(o, "o_totalprice", "o_orderkey", 10)), ("top5", 1, top_k(o, "o_totalprice", "o_orderkey", 5))]).select("method", "seed", "o_orderkey")


def set_ops(spark, d):
    a = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    b = table(spark, d, "orders").filter("o_orderpriority like '1%'").select(F.col("o_custkey").alias("k"))
    both, only = a.intersect(b), a.subtract(b)
    return both.agg(F.count(F.lit(1)).alias("n_both")).crossJoin(only.agg(F.count(F.lit(1)).alias("n_only")))


QUERIES = {
    "frame_topk_quota": (frame_topk_quota, FRAME_TOPK_SQL),
    "contract_profile": (contract_profile, "SELECT count(*) AS n_rows, count(*) FILTER (l_quantity IS NULL) AS null_quantity, count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')) AS bad_flag, (count(*) - count(DISTINCT (l_orderkey, l_linenumber)))::BIGINT AS dup_rows FROM lineitem"),
    "latest_prev_change": (latest_prev_change, f"WITH {FRAMES_SQL} SELECT event_id, round_even(CASE WHEN frame_idx - lag(frame_idx) OVER w = 1 THEN abs(value - lag(value) OVER w) / greatest(value, lag(value) OVER w, 1.0) ELSE 0.0 END, 6) AS det_tmp FROM f WINDOW w AS (PARTITION BY user_id, event_type ORDER BY frame_idx)"),
    "binary_entropy_by_frame": (binary_entropy_by_frame, f"WITH {OBJECTS_SQL}, p AS (SELECT l_orderkey, l_discount * 9 + 0.05::DOUBLE AS p FROM o), q AS (SELECT l_orderkey, p, least(greatest(p, 1e-6), 1 - 1e-6) AS c FROM p) SELECT l_orderkey, count(*) AS det_n, round_even(avg(-(c * ln(c) + (1 - c) * ln(1 - c)) / ln(2)), 6) AS det_ent, count(*) FILTER (p >= 0.5) AS det_n_conf FROM q GROUP BY l_orderkey"),
    "pct_rank_masked": (pct_rank_masked, f"WITH {FRAMES_SQL}, k AS (SELECT event_id, floor(value) AS v FROM f WHERE event_type <> 'view'), r AS (SELECT event_id, {_rank_sql('v')} AS r FROM k) SELECT f.event_id, round_even(coalesce(r.r, 0), 6) AS r FROM f LEFT JOIN r USING (event_id)"),
    "pct_rank_by_split": (pct_rank_by_split, f"WITH {FRAMES_SQL}, s AS (SELECT *, CASE WHEN user_id % 4 = 0 THEN 'V' ELSE 'P' END AS split FROM f) SELECT event_id, split, round_even({_rank_sql('value', 'split')}, 6) AS r FROM s"),
    "frame_best_image": (frame_best_image, f"WITH {OBJECTS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM o), a AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, count(*) AS n_objects FROM o GROUP BY 1) SELECT l_orderkey, l_linenumber AS best_line, l_partkey AS best_part, l_extendedprice AS best_price, any_returned, n_objects FROM b JOIN a USING (l_orderkey) WHERE n = 1"),
    "topk_desc_token": (topk_desc_token, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "random_hash_quota": (random_hash_quota, f"WITH {FRAMES_SQL}, h AS (SELECT event_id, user_id, sha1(event_id::VARCHAR || '|7') AS h FROM f), n AS (SELECT user_id, count(*) AS c FROM f GROUP BY 1), m AS (SELECT min(m) AS m FROM (SELECT g.m, sum(least(g.m, c)) AS s, sum(c) AS t FROM n, (SELECT unnest(range(1, 200)) AS m) g GROUP BY g.m) WHERE s >= least(40, t)), q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h, event_id) AS k FROM h) SELECT event_id, user_id FROM q, m WHERE k <= m.m ORDER BY h, event_id LIMIT 40"),
    "minmax_p1_p99_score": (minmax_p1_p99_score, f"WITH {FRAMES_SQL}, k AS (SELECT *, event_type <> 'view' AS keep, frame_idx::DOUBLE AS change FROM f), q AS (SELECT quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b, quantile_cont(change, 0.01) AS c, quantile_cont(change, 0.99) AS d FROM k WHERE keep) SELECT event_id, round_even(CASE WHEN keep THEN least(1.0, greatest(0.0, 0.7::DOUBLE * (CASE WHEN b > a THEN least(1.0, greatest(0.0, (value - a) / (b - a))) ELSE 0 END) + 0.3::DOUBLE * (CASE WHEN d > c THEN least(1.0, greatest(0.0, (change - c) / (d - c))) ELSE 0 END))) ELSE 0.0 END, 6) AS s FROM k, q"),
    "percentile_linear": (percentile_linear, f"WITH {OBJECTS_SQL} SELECT l_returnflag, " + ", ".join(f"round_even(quantile_cont(l_extendedprice, {q}), 6) AS p{int(q * 100)}" for q in (0.01, 0.2, 0.5, 0.97)) + " FROM o GROUP BY 1"),
    "quantile_higher_by_class": (quantile_higher_by_class, f"WITH {OBJECTS_SQL}, s AS (SELECT l_returnflag, l_linestatus, list(l_extendedprice ORDER BY l_extendedprice) AS v FROM o GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, v[ceil((len(v) - 1) * 0.9::DOUBLE)::BIGINT + 1] AS q90 FROM s"),
    "discrete_percentile": (discrete_percentile, f"WITH {OBJECTS_SQL} SELECT l_linestatus, quantile_disc(l_quantity, 0.25) AS p25 FROM o GROUP BY 1"),
    "hist_equal_width": (hist_equal_width, f"WITH {FRAMES_SQL}, x AS (SELECT least(value / 100.0, 1.0) AS x FROM f), h AS (SELECT (least(floor(x * 20), 19) + 1)::INTEGER AS bin, count(*) AS n FROM x WHERE x BETWEEN 0 AND 1 GROUP BY 1) SELECT b.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, 21))::INTEGER AS bin) b LEFT JOIN h ON h.bin = b.bin"),
    "hist_unequal": (hist_unequal, f"WITH {OBJECTS_SQL} SELECT " + ", ".join(f"count(*) FILTER (l_quantity >= {10 * k}" + (f" AND l_quantity < {10 * k + 10})" if k < 5 else ")") + f" AS bin{k}" for k in range(6)) + " FROM o"),
    "normalised_hist": (normalised_hist, f"WITH {OBJECTS_SQL}, c AS (SELECT l_returnflag, least(greatest(l_quantity, 5.0), 40.0) AS q FROM o) SELECT l_returnflag, round_even(avg((q >= 5 AND q < 10)::INT), 6) AS h0, round_even(avg((q >= 10 AND q < 20)::INT), 6) AS h1, round_even(avg((q >= 20)::INT), 6) AS h2 FROM c GROUP BY 1"),
    "bev_grid": (bev_grid, f"WITH {OBJECTS_SQL}, g AS (SELECT l_returnflag, least(greatest(floor((l_discount * 500 - 25 + 20) / 5), 0), 7)::INTEGER AS iy, least(greatest(floor((l_quantity - 25 + 20) / 5), 0), 7)::INTEGER AS ix FROM o) SELECT l_returnflag, iy, ix, count(*) AS n, round_even(ln(1 + count(*)), 6) AS log_n FROM g GROUP BY 1, 2, 3"),
    "voxel_first": (voxel_first, f"WITH {OBJECTS_SQL}, v AS (SELECT *, floor(l_quantity / 10)::BIGINT AS vx, floor(l_discount * 50 + 1e-9)::BIGINT AS vy FROM o) SELECT l_returnflag, vx, vy, l_orderkey, l_linenumber FROM v QUALIFY row_number() OVER (PARTITION BY l_returnflag, vx, vy ORDER BY l_orderkey, l_linenumber) = 1"),
    "majority_mode": (majority_mode, f"WITH {FRAMES_SQL}, c AS (SELECT user_id, event_type, count(*) AS c, sum(count(*)) OVER (PARTITION BY user_id) AS n FROM f GROUP BY 1, 2), w AS (SELECT user_id, min(event_type) AS mode_type FROM c WHERE 2 * c > n GROUP BY 1) SELECT DISTINCT f.user_id, mode_type FROM f LEFT JOIN w USING (user_id)"),
    "spaced_frames": (spaced_frames, f"WITH RECURSIVE {FRAMES_SQL}, k AS (SELECT user_id, frame_idx FROM f WHERE value > 10), g(user_id, x, n) AS (SELECT user_id, min(frame_idx), 1 FROM k GROUP BY 1 UNION ALL SELECT user_id, y, n + 1 FROM (SELECT g.user_id, g.n, (SELECT min(k.frame_idx) FROM k WHERE k.user_id = g.user_id AND k.frame_idx >= g.x + 4) AS y FROM g) WHERE y IS NOT NULL) SELECT user_id, max(n)::INTEGER AS n_spaced FROM g GROUP BY 1"),
    "temporal_redundancy": (temporal_redundancy, f"WITH {FRAMES_SQL} SELECT event_id, coalesce(t - lag(t) OVER w <= 86400000000, false) OR coalesce(lead(t) OVER w - t <= 86400000000, false) AS redundant FROM f WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY t)"),
    "asof_previous": (asof_previous, f"WITH {FRAMES_SQL} SELECT c.event_id, v.event_id AS view_id FROM (SELECT * FROM f WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM f WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.t >= v.t"),
    "asof_nearest": (asof_nearest_query, f"WITH {FRAMES_SQL}, c AS (SELECT * FROM f WHERE event_type = 'click'), v AS (SELECT * FROM f WHERE event_type = 'view'), m AS (SELECT c.event_id, v.event_id AS view_id, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(c.t - v.t), v.t) AS n FROM c JOIN v ON c.user_id = v.user_id AND abs(c.t - v.t) <= 86400000000) SELECT c.event_id, m.view_id FROM c LEFT JOIN m ON m.event_id = c.event_id AND n = 1"),
    "chain_walk": (chain_walk_query, "WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations) SELECT conv_id || ':' || min(turn) OVER (PARTITION BY conv_id) AS first, conv_id || ':' || turn AS token, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM c"),
    "keyword_flags": (keyword_flags, "SELECT doc_id, contains(lower(coalesce(text, '')), 'license') OR contains(lower(coalesce(text, '')), 'copyright') AS night, contains(lower(coalesce(text, '')), 'worthless') OR contains(lower(coalesce(text, '')), 'stupid') AS rain FROM documents"),
    "json_extract": (json_extract, "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "slug": (slug_query, "WITH s AS (SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 32) AS s FROM part) SELECT p_partkey, CASE WHEN length(s) > 0 THEN s ELSE 'query' END AS slug FROM s"),
    "pipe_sets": (pipe_sets, f"WITH {OBJECTS_SQL} SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS tags, count(DISTINCT l_returnflag)::INTEGER AS n_tags FROM o GROUP BY 1"),
    "right_bins": (right_bins, f"WITH {OBJECTS_SQL} SELECT (CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity < 20 THEN 1 ELSE 2 END)::INTEGER AS bin, count(*) AS n FROM o GROUP BY 1"),
    "cube_summary": (cube_summary, f"WITH {OBJECTS_SQL} SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS qty FROM o GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "pivot_status": (pivot_status, f"WITH {OBJECTS_SQL} SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM o GROUP BY 1"),
    "tumbling_days": (tumbling_hours, f"WITH {FRAMES_SQL} SELECT t // 86400000000 AS day, event_type, count(*) AS n FROM f GROUP BY 1, 2"),
    "sessions": (sessions, f"WITH {FRAMES_SQL}, n AS (SELECT *, CASE WHEN t - lag(t) OVER w > 86400000000 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), s AS (SELECT *, (sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM n) SELECT user_id, session, count(*) AS n, max(t) - min(t) AS length_us FROM s GROUP BY 1, 2"),
    "union_runs": (union_runs, "(SELECT 'top' AS method, 0 AS seed, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) UNION ALL (SELECT 'top5', 1, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)"),
    "set_ops": (set_ops, "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%') SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS n_both, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS n_only"),
}

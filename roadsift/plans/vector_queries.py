"""Queries of similarity, selection and coverage over the embedding table (label = scene, position in the label = frame index)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.ranks import bround6
from ..functions.vectors import distance, dot
from ..operators import selection as sel
from ..operators import similarity as sim
from .frames import OBJECTS_SQL, objects, vectors

THETA, BUDGET = 0.35, 12


def pool(spark, d):
    v = vectors(spark, d)
    w = Window.partitionBy("label").orderBy("vec_id")
    return v.withColumns({"idx": F.row_number().over(w) - 1, "s": bround6((F.col("embedding")[0].cast("double") + 1) / 2), "ok": F.col("vec_id") % 7 != 0})


POOL_SQL = """
p AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS z, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx,
         round_even((embedding[1]::DOUBLE + 1) / 2, 6) AS s, vec_id % 7 <> 0 AS ok
  FROM embeddings)
"""


def _knn_sql(value: str, k: int, where: str) -> str:
    return f"""WITH {POOL_SQL}, n AS (
      SELECT a.vec_id, {value} AS v, row_number() OVER (PARTITION BY a.vec_id ORDER BY {value}) AS n FROM p a JOIN p b ON {where})
    SELECT p.vec_id, round_even(coalesce(avg(v) FILTER (n <= {k}), 0), 6) AS v FROM p LEFT JOIN n USING (vec_id) GROUP BY 1"""


_L2 = "sqrt(list_sum(list_transform(list_zip(a.z, b.z), lambda t: (t[1] - t[2]) * (t[1] - t[2]))))"
_COS = "1 - list_dot_product(a.z, b.z)"


def _named(df):
    return df.select("vec_id", bround6(F.col(df.columns[1])).alias("v"))


def novelty_knn_cosine(spark, d):
    return _named(sim.novelty_knn(pool(spark, d), "vec_id", "embedding", "label", "idx", 10))


def novelty_blocks(spark, d):
    """The same in blocks, as for tables beyond the broadcast limit."""
    return _named(sim.novelty_knn(pool(spark, d), "vec_id", "embedding", "label", "idx", 10, broadcast_bytes=0))


def rarity_knn_pivots(spark, d):
    """The same distances by the pivot index: only block pairs that triangle bounds cannot rule out are compared."""
    return _named(sim.rarity_knn(pool(spark, d), "vec_id", "embedding", "label", "ok", 10, broadcast_bytes=0))


def rarity_knn_l2(spark, d):
    return _named(sim.rarity_knn(pool(spark, d), "vec_id", "embedding", "label", "ok", 10))


def novelty_to_seed(spark, d):
    p = pool(spark, d)
    return _named(sim.novelty_to_seed(p, p.filter("label = 3"), "vec_id", "embedding"))


def novelty_single_scene_gap(spark, d):
    """All rows as one scene: neighbours are frames at least four away."""
    return _named(sim.novelty_knn(pool(spark, d).withColumn("one", F.lit(1)), "vec_id", "embedding", "one", "idx", 5, 4))


def query_best_match(spark, d):
    v = vectors(spark, d)
    queries = [(f"q{r['vec_id']}", [float(x) for x in r["embedding"]]) for r in v.filter("vec_id in (1, 2, 3)").orderBy("vec_id").collect()]
    return sim.query_scores(v, "vec_id", "embedding", queries).select("vec_id", bround6(F.col("qry_max")).alias("qry_max"), "qry_best")


def frame_embedding_mean(spark, d):
    v = vectors(spark, d).withColumn("chosen", F.col("vec_id") % 3 == 0)
    return sim.mean_vector(v, "label", "embedding", "chosen").select("label", *[bround6(F.col("embedding")[k]).alias(f"e{k}") for k in range(4)])


def similar_pairs(spark, d):
    return sim.similar_pairs(vectors(spark, d), "vec_id", "embedding", THETA).select("a", "b", bround6(F.col("cos")).alias("cos"))


def duplicate_groups(spark, d):
    return sim.duplicate_groups(vectors(spark, d), "vec_id", "embedding", THETA).select("vec_id", F.col("group").alias("group_id"))


def pair_redundancy(spark, d):
    return sim.pair_redundancy(vectors(spark, d), "vec_id", "embedding", 0.2).select("n", "close", bround6(F.col("redundancy")).alias("redundancy"))


def ood_deviation(spark, d):
    out = sim.ood_deviation(pool(spark, d), "vec_id", "embedding", "ok")
    return out.select("vec_id", bround6(F.col("deviation")).alias("deviation"), bround6(F.col("spread")).alias("spread"))


def vector_expressions(spark, d):
    v = vectors(spark, d)
    first = v.filter("vec_id = 1").select(F.col("embedding").alias("e1"))
    return v.crossJoin(F.broadcast(first)).select("vec_id", bround6(dot(F.col("embedding"), F.col("e1"))).alias("cos"), bround6(distance(F.col("embedding"), F.col("e1"))).alias("l2"))


def _mmr_sql(lam: float, m: int, gap: int, budget: int, where: str = "ok") -> str:
    ctes = [POOL_SQL, f"m0 AS MATERIALIZED (SELECT vec_id, label, z, idx, s, 0.0::DOUBLE AS ms, NOT ({where}) AS blocked, 0 AS c FROM p)"]
    for k in range(1, budget + 1):
        ctes.append(f"k{k} AS MATERIALIZED (SELECT {k} AS rank, vec_id, label, z, idx, ms, {lam}::DOUBLE * s - {1 - lam}::DOUBLE * ms AS u FROM m{k - 1} WHERE NOT blocked AND c < {m} ORDER BY u DESC, vec_id LIMIT 1)")
        ctes.append(
            f"m{k} AS MATERIALIZED (SELECT m.vec_id, m.label, m.z, m.idx, m.s, greatest(m.ms, least(1.0, greatest(0.0, list_dot_product(m.z, k.z)))) AS ms, "
            f"m.blocked OR m.vec_id = k.vec_id OR (m.label = k.label AND abs(m.idx - k.idx) < {gap}) AS blocked, m.c + (m.label = k.label)::INT AS c FROM m{k - 1} m, k{k} k)"
        )
    picks = " UNION ALL ".join(f"SELECT vec_id, rank, ms, u FROM k{k}" for k in range(1, budget + 1))
    return f"WITH {', '.join(ctes)} SELECT vec_id, rank::INTEGER AS rank, round_even(ms, 6) AS max_sim, round_even(u, 6) AS mmr_util FROM ({picks})"


def _mmr(spark, d, lam, m, gap, **more):
    out, _ = sel.mmr_select(pool(spark, d), "vec_id", "s", "embedding", "label", "idx", BUDGET, "ok", None, lam, m, gap, **more)
    return out.select("vec_id", "rank", bround6(F.col("max_sim")).alias("max_sim"), bround6(F.col("mmr_util")).alias("mmr_util"))


def mmr_select(spark, d):
    return _mmr(spark, d, 0.7, 100, 1)


def mmr_quota_gap(spark, d):
    return _mmr(spark, d, 0.5, 2, 4)


def mmr_relaxed(spark, d):
    """A quota of one a scene cannot fill the budget over ten scenes: it rises to two."""
    return _mmr(spark, d, 0.5, 1, 1, relax=True)


def _coreset_sql(start: str, dist: str) -> str:
    ctes = [POOL_SQL, f"k1 AS MATERIALIZED ({start})", f"m1 AS MATERIALIZED (SELECT a.vec_id, a.z, {dist} AS dd FROM p a, k1 b WHERE a.vec_id <> b.vec_id)"]
    for k in range(2, BUDGET + 1):
        ctes.append(f"k{k} AS MATERIALIZED (SELECT vec_id, z FROM m{k - 1} ORDER BY dd DESC, vec_id LIMIT 1)")
        ctes.append(f"m{k} AS MATERIALIZED (SELECT a.vec_id, a.z, least(a.dd, {dist}) AS dd FROM m{k - 1} a, k{k} b WHERE a.vec_id <> b.vec_id)")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT vec_id, {k}::INTEGER AS rank FROM k{k}" for k in range(1, BUDGET + 1))


def coreset_l2(spark, d):
    return sel.coreset_l2(pool(spark, d), "vec_id", "embedding", "s", BUDGET)


def coreset_cosine(spark, d):
    return sel.coreset_cosine(pool(spark, d), "vec_id", "embedding", BUDGET)


def _cover(spark, d):
    return objects(spark, d, ["l_suppkey", "l_partkey"]).select("l_suppkey", (F.col("l_partkey") % 500).alias("inst")).distinct()


def max_cover_oracle(spark, d):
    return sel.max_cover(_cover(spark, d), "l_suppkey", "inst", 8)


def _cover_sql(budget: int) -> str:
    ctes = [OBJECTS_SQL, "c0 AS MATERIALIZED (SELECT DISTINCT l_suppkey, l_partkey % 500 AS inst FROM o)", "s0 AS MATERIALIZED (SELECT DISTINCT l_suppkey FROM c0)"]
    for k in range(1, budget + 1):
        ctes.append(f"g{k} AS MATERIALIZED (SELECT s.l_suppkey, count(c.inst) AS gain FROM s{k - 1} s LEFT JOIN c{k - 1} c USING (l_suppkey) GROUP BY 1 ORDER BY gain DESC, l_suppkey LIMIT 1)")
        ctes.append(f"c{k} AS MATERIALIZED (SELECT * FROM c{k - 1} WHERE inst NOT IN (SELECT x.inst FROM c{k - 1} x JOIN g{k} USING (l_suppkey)))")
        ctes.append(f"s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} WHERE l_suppkey NOT IN (SELECT l_suppkey FROM g{k}))")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT l_suppkey, {k}::INTEGER AS rank, gain::INTEGER AS gain FROM g{k}" for k in range(1, budget + 1))


def rare_two_phase(spark, d):
    """Two-phase selection; checked by tests, since both phases rank every eligible frame."""
    p = pool(spark, d)
    out, _ = sel.rare_select(p, "vec_id", "s", "embedding", "label", "idx", "ok", p.filter("label = 0").select("vec_id"), 25)
    return out


def embedding_pca(spark, d):
    """Block z-scores and PCA, sign-fixed; checked by tests against a dense decomposition."""
    p = pool(spark, d).withColumns({"a": F.slice("embedding", 1, 9), "b": F.slice("embedding", 10, 16)})
    out = sim.embed_blocks(p, "vec_id", ["a", "b"], "ok", 6)
    return out.select("vec_id", *[bround6(F.col("embedding")[k]).alias(f"z{k}") for k in range(6)])


_CROSS = "a.label <> b.label"
_SIMILAR = f"e AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.z, b.z) AS cos FROM p a JOIN p b ON a.vec_id < b.vec_id AND list_dot_product(a.z, b.z) > {THETA})"

QUERIES = {
    "novelty_knn_cosine": (novelty_knn_cosine, _knn_sql(_COS, 10, _CROSS)),
    "novelty_knn_blocks": (novelty_blocks, _knn_sql(_COS, 10, _CROSS)),
    "rarity_knn_l2": (rarity_knn_l2, _knn_sql(_L2, 10, _CROSS + " AND b.ok")),
    "rarity_knn_pivots": (rarity_knn_pivots, _knn_sql(_L2, 10, _CROSS + " AND b.ok")),
    "novelty_to_seed": (novelty_to_seed, _knn_sql(_L2, 1, "b.label = 3")),
    "novelty_single_scene_gap": (novelty_single_scene_gap, _knn_sql(_COS, 5, "abs(a.idx - b.idx) >= 4")),
    "query_best_match": (query_best_match, f"WITH {POOL_SQL}, q AS (SELECT a.vec_id, b.vec_id AS q, list_dot_product(a.z, b.z) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.z, b.z) DESC, b.vec_id) AS n FROM p a, p b WHERE b.vec_id IN (1, 2, 3)) SELECT vec_id, round_even(s, 6) AS qry_max, 'q' || q AS qry_best FROM q WHERE n = 1"),
    "frame_embedding_mean": (frame_embedding_mean, f"WITH {POOL_SQL}, x AS (SELECT label, vec_id % 3 = 0 AS c, unnest(z) AS x, generate_subscripts(z, 1) AS i FROM p), m AS (SELECT label, i, coalesce(avg(x) FILTER (c), avg(x)) AS m FROM x GROUP BY 1, 2), n AS (SELECT label, greatest(sqrt(sum(m * m)), 1e-12) AS n FROM m GROUP BY 1) SELECT label, " + ", ".join(f"round_even(max(m / n) FILTER (i = {k + 1}), 6) AS e{k}" for k in range(4)) + " FROM m JOIN n USING (label) GROUP BY 1"),
    "similar_pairs": (similar_pairs, f"WITH {POOL_SQL}, {_SIMILAR} SELECT a, b, round_even(cos, 6) AS cos FROM e"),
    "duplicate_groups": (duplicate_groups, f"WITH RECURSIVE {POOL_SQL}, {_SIMILAR}, l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(vec_id, g) AS (SELECT vec_id, vec_id FROM p UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.g = l.a) SELECT vec_id, min(g) AS group_id FROM r GROUP BY 1"),
    "pair_redundancy": (pair_redundancy, f"WITH {POOL_SQL}, c AS (SELECT count(*) AS c FROM p a JOIN p b ON a.vec_id < b.vec_id AND list_dot_product(a.z, b.z) > 0.2), n AS (SELECT count(*) AS n FROM p) SELECT n, c AS close, round_even(c / (n * (n - 1) / 2), 6) AS redundancy FROM c, n"),
    "ood_deviation": (ood_deviation, f"WITH {POOL_SQL}, x AS (SELECT vec_id, ok, unnest(z) AS x, generate_subscripts(z, 1) AS i FROM p), m AS (SELECT i, avg(x) AS m FROM x WHERE ok GROUP BY 1), dd AS (SELECT vec_id, ok, sum((x - m) * (x - m)) AS d2 FROM x JOIN m USING (i) GROUP BY 1, 2), s AS (SELECT sqrt(avg(d2)) AS s FROM dd WHERE ok) SELECT vec_id, round_even(sqrt(d2), 6) AS deviation, round_even(s, 6) AS spread FROM dd, s"),
    "vector_expressions": (vector_expressions, f"WITH {POOL_SQL} SELECT a.vec_id, round_even(list_dot_product(a.z, b.z), 6) AS cos, round_even({_L2}, 6) AS l2 FROM p a, p b WHERE b.vec_id = 1"),
    "mmr_select": (mmr_select, _mmr_sql(0.7, 100, 1, BUDGET)),
    "mmr_quota_gap": (mmr_quota_gap, _mmr_sql(0.5, 2, 4, BUDGET)),
    "mmr_relaxed": (mmr_relaxed, _mmr_sql(0.5, 2, 1, BUDGET)),
    "coreset_l2": (coreset_l2, _coreset_sql("SELECT vec_id, z FROM p ORDER BY s DESC, vec_id LIMIT 1", _L2)),
    "coreset_cosine": (coreset_cosine, _coreset_sql("SELECT a.vec_id, a.z FROM p a, (SELECT list(m ORDER BY i) AS z FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(z) AS x, generate_subscripts(z, 1) AS i FROM p) GROUP BY i)) b ORDER BY list_dot_product(a.z, b.z) / sqrt(list_dot_product(b.z, b.z)), a.vec_id LIMIT 1", _COS)),
    "max_cover_oracle": (max_cover_oracle, _cover_sql(8)),
    "rare_two_phase": (rare_two_phase, None),
    "embedding_pca": (embedding_pca, None),
}

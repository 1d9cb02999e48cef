"""Subset selection: top-k, quotas, MMR, core-sets, coverage, random baselines.

Orders and quotas are DataFrame plans.  Greedy selectors (``greedy.py``) keep the pool on
the executors; the driver chooses among a bounded frontier a round and gives the result
back as a DataFrame.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import bround6, robust_minmax
from ..functions.vectors import FLOOR
from ..scratch import written
from . import greedy
from .aggregates import exact_percentiles, spaced_count

#: Chosen rows that the driver holds before they are written away.
FLUSH = 100_000


def budget_rows(df: DataFrame, fraction: float, floor: bool = True) -> Column:
    """ceil(fraction * rows) as a column over the whole table."""
    n = F.ceil(F.bround(F.count(F.lit(1)).over(Window.partitionBy()) * F.lit(fraction), 9))
    return F.greatest(n, F.lit(1)) if floor else n


def top_k(df: DataFrame, score: str | Column, token: str, k: int) -> DataFrame:
    """The k best by falling score, ties by token."""
    s = F.col(score) if isinstance(score, str) else score
    return df.orderBy(s.desc(), F.col(token).asc()).limit(k)


def bottom_k(df: DataFrame, score: str, token: str, k: int) -> DataFrame:
    return df.orderBy(F.col(score).asc(), F.col(token).asc()).limit(k)


def ranked(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy().orderBy(*order)))


def top_k_quota(df: DataFrame, score: str, scene: str, token: str, k: int, per_scene: int) -> DataFrame:
    """The k best with at most ``per_scene`` rows a scene; the window keeps only the quota per partition before the global order."""
    w = Window.partitionBy(scene).orderBy(F.col(score).desc(), F.col(token).asc())
    return top_k(df.withColumn("scene_rank", F.row_number().over(w)).filter(F.col("scene_rank") <= per_scene), score, token, k)


def smallest_quota(df: DataFrame, scene: str, k: int, start: int = 1) -> int:
    """Smallest per-scene quota, from ``start`` on, that lets min(k, rows) rows be chosen; found from the distribution of scene sizes."""
    sizes = df.groupBy(scene).agg(F.count(F.lit(1)).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("s")).collect()
    total = sum(r["c"] * r["s"] for r in sizes)
    m = start
    while sum(min(m, r["c"]) * r["s"] for r in sizes) < min(k, total):
        m += 1
    return m


def random_order(df: DataFrame, token: str, seed: int, method: str = "sha1") -> Column:
    """A seeded pseudo-random key that any SQL engine can recompute."""
    text = F.concat_ws("|", F.col(token).cast("string"), F.lit(str(seed)))
    return F.sha1(text) if method == "sha1" else F.md5(text)


def random_k(df: DataFrame, token: str, k: int, seed: int) -> DataFrame:
    return df.orderBy(random_order(df, token, seed), F.col(token)).limit(k)


def random_k_quota(df: DataFrame, scene: str, token: str, k: int, per_scene: int, seed: int) -> DataFrame:
    """Seeded random order, at most m rows a scene; m rises until k rows can be had."""
    m = smallest_quota(df, scene, k, per_scene)
    key = random_order(df, token, seed)
    w = Window.partitionBy(scene).orderBy(key, F.col(token))
    return df.withColumn("scene_rank", F.row_number().over(w)).filter(F.col("scene_rank") <= m).orderBy(key, F.col(token)).limit(k)


def random_permutation(df: DataFrame, token: str, k: int, seed: int) -> list[str]:
    """The NumPy PCG64 permutation of the sorted tokens, for parity with stored runs."""
    tokens = sorted(r[0] for r in df.select(token).collect())
    return [tokens[i] for i in np.random.default_rng(seed).permutation(len(tokens))[:k]]


def minmax_score(df: DataFrame, parts: Sequence[tuple[str, float]], keep: str, out: str = "s", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Weighted sum of positions between the 1st and 99th percentile of kept rows, clipped to [0, 1], six decimals."""
    total = F.lit(0.0)
    for c, w in parts:
        if w > 0:
            cuts = exact_percentiles(df.filter(keep), c, [low, high])
            if None not in cuts:
                total = total + F.lit(w) * F.coalesce(robust_minmax(F.col(c), F.lit(cuts[0]), F.lit(cuts[1]), F.col(keep)), F.lit(0.0))
    return df.withColumn(out, bround6(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))))


def _result(df: DataFrame, token: str, rounds: Iterable[list[tuple]], extra: str = "") -> tuple[DataFrame, int]:
    """(token, rank and what else a choice carries) of all rounds, and how many rows that are."""
    spark, schema = df.sparkSession, f"{token} {df.schema[token].dataType.simpleString()}, rank int{extra}"
    parts: list[DataFrame] = []
    rows: list[tuple] = []
    n = 0
    for chosen in rounds:
        for first, *more in chosen:
            n += 1
            rows.append((first, n, *more))
        if len(rows) >= FLUSH:
            parts.append(written(spark.createDataFrame(rows, schema), "chosen"))
            rows = []
    out = spark.createDataFrame(rows, schema)
    for part in parts:
        out = out.unionByName(part)
    return out, n


def mmr_select(
    df: DataFrame, token: str, score: str, vector: str, scene: str, index: str, budget: int, ok: str | None = None, most: int | None = None, lam: float = 0.7, per_scene: int | None = 4, min_gap: int = 1, relax: bool = False,
    frontier: int = greedy.FRONTIER,
) -> tuple[DataFrame, list[str]]:
    """(token, rank, max_sim, mmr_util) and warnings.

    With ``relax`` the quota first rises to the least that can fill the budget, then by one
    while picks fall short, then the gap halves; each step is a warning."""
    good = df.filter(F.coalesce(F.col(ok), F.lit(False))) if ok else df
    pool = written(
        good.select(F.col(token).alias("token"), F.col(scene).alias("scene"), F.col(index).cast("long").alias("idx"), (F.rint(F.col(score).cast("double") * 1e6) / 1e6).alias("s"), F.col(vector).cast("array<double>").alias("v")), "pool"
    )
    most = most or budget
    warnings: list[str] = []
    m: float = math.inf if per_scene is None else per_scene
    eligible = pool.count()

    def run() -> tuple[DataFrame, int]:
        return _result(df, token, greedy.mmr(pool, budget, most, lam, m, min_gap, frontier) if eligible else (), ", max_sim double, mmr_util double")

    def fitting() -> Counter:
        """How many scenes have room for how many spaced frames."""
        return Counter({r["n"]: r["scenes"] for r in spaced_count(pool, "scene", "idx", min_gap).groupBy("n").agg(F.count(F.lit(1)).alias("scenes")).collect()})

    if relax and per_scene is not None and eligible:
        fits = fitting()
        while sum(f * c for f, c in fits.items()) < min(budget, eligible) and min_gap > 1:
            min_gap //= 2
            warnings.append(f"min_gap lowered to {min_gap}")
            fits = fitting()
        start = m
        while sum(min(m, f) * c for f, c in fits.items()) < min(budget, sum(f * c for f, c in fits.items())):
            m += 1
        if m > start:
            warnings.append(f"per-scene quota raised to {m:.0f}")
    picks, n = run()
    while relax and per_scene is not None and n < min(budget, eligible):
        if m < max(fits):
            m += 1
            warnings.append(f"per-scene quota raised to {m:.0f}")
        elif min_gap > 1:
            min_gap //= 2
            warnings.append(f"min_gap lowered to {min_gap}")
        else:
            break
        picks, n = run()
    return picks, warnings


def coreset_l2(df: DataFrame, token: str, vector: str, start_score: str, budget: int, frontier: int = greedy.FRONTIER) -> DataFrame:
    """k-center greedy from the highest score."""
    pool = written(df.select(F.col(token).alias("token"), F.col(vector).cast("array<double>").alias("v"), F.col(start_score).cast("double").alias("s")), "pool")
    return _result(df, token, greedy.k_center(pool, F.col("s").desc(), budget, "l2", frontier))[0]


def coreset_cosine(df: DataFrame, token: str, vector: str, budget: int, frontier: int = greedy.FRONTIER) -> DataFrame:
    """k-center greedy on cosine distance, from the row farthest from the normalised mean."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    raw = df.select(F.col(token).alias("token"), F.col(vector).cast("array<double>").alias("v"))
    pool = written(raw.select("token", F.transform("v", lambda x: x / F.greatest(length, F.lit(1e-12))).alias("v")), "pool")
    means = pool.select(F.posexplode("v").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m")).orderBy("p").collect()  # a row a dimension
    mean = np.asarray([r["m"] for r in means])
    mean = mean / max(float(np.linalg.norm(mean)), FLOOR) if len(mean) else mean
    towards = F.aggregate(F.zip_with("v", F.lit(mean.tolist()), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return _result(df, token, greedy.k_center(pool, towards.asc(), budget, "cosine", frontier))[0]


def max_cover(df: DataFrame, token: str, instance: str, budget: int, frames: DataFrame | None = None, frontier: int = greedy.FRONTIER) -> DataFrame:
    """Greedy cover of instances by frames: (token, rank, gain)."""
    covers = df.select(F.col(token).alias("token"), F.col(instance).alias("inst"))
    rows = (frames if frames is not None else df).select(F.col(token).alias("token"))
    return _result(df, token, greedy.max_cover(covers, rows, budget, frontier), ", gain int")[0]


def label_oracle(df: DataFrame, rare: str, n_cells: str, token: str, budget: int, seed: int = 0) -> DataFrame:
    """Rare rows by falling number of rare cells, then a seeded random fill."""
    order = [F.col(rare).desc(), F.when(F.col(rare), -F.col(n_cells)), F.when(~F.col(rare), random_order(df, token, seed)), F.col(token)]
    return df.orderBy(*order).limit(budget)


def track_penalty(objects: DataFrame, frame: str, track: str, score: str) -> DataFrame:
    """Frames that hold tracked objects but are the best frame of none of these tracks."""
    tracked = objects.filter(F.coalesce(F.col(track), F.lit("")) != "")
    w = Window.partitionBy(track).orderBy(F.col(score).desc(), F.col(frame).asc())
    best = tracked.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(frame).distinct()
    return tracked.select(frame).distinct().join(best, frame, "left_anti")


def rare_select(
    df: DataFrame, token: str, score: str, vector: str, scene: str, index: str, eligible: str, penalised: DataFrame, budget: int, lam: float = 0.7, per_scene: int | str | None = "even", frontier: int = greedy.FRONTIER,
) -> tuple[DataFrame, list[str]]:
    """Two phases of MMR over the eligible frames: unpenalised with a quota, then the rest with halved scores and none.

    Returns (token, rank, selected, explore): all eligible frames are ranked, the first
    ``budget`` are selected, ``explore`` are selected frames outside the pure top."""
    pool = df.filter(eligible)
    n = pool.count()
    if not n:
        kind = df.schema[token].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"{token} {kind}, rank int, selected boolean, explore boolean"), ["ELIGIBLE_ZERO"]
    warnings = ["ELIGIBLE_LT_B"] if n < budget else []
    budget = min(budget, n)
    if per_scene == "even":
        per_scene = -(-budget // pool.select(scene).distinct().count())
    marked = written(pool.join(penalised.select(token).distinct().withColumn("__p", F.lit(True)), token, "left").withColumn("__p", F.coalesce("__p", F.lit(False))), "eligible")
    first, _ = mmr_select(marked.filter("not __p"), token, score, vector, scene, index, budget, None, n, lam, per_scene, 1, frontier=frontier)
    ahead = first.count()
    rest = marked.join(first, token, "left_anti").withColumn("__s", F.when(F.col("__p"), F.col(score) * 0.5).otherwise(F.col(score)))
    second, _ = mmr_select(rest, token, "__s", vector, scene, index, max(1, n - ahead), None, n, lam, None, 1, frontier=frontier)
    order = first.select(token, "rank").unionByName(second.select(token, (F.col("rank") + ahead).alias("rank")))
    pure = top_k(pool, score, token, budget).select(token).withColumn("__pure", F.lit(True))
    chosen = F.col("rank") <= budget
    return order.join(pure, token, "left").select(token, "rank", chosen.alias("selected"), (chosen & F.col("__pure").isNull()).alias("explore")), warnings


def prefix(ranking: DataFrame, pool: DataFrame, token: str, budget: int, rank: str = "rank") -> DataFrame:
    """A stored ranking as a selector: only pool tokens, in rank order, cut at the budget."""
    return ranking.join(pool.select(token).distinct(), token, "left_semi").orderBy(rank).limit(budget)


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def union_runs(runs: Sequence[tuple[str, int, DataFrame]]) -> DataFrame:
    """UNION ALL of selections with their method and seed."""
    out: DataFrame | None = None
    for method, seed, df in runs:
        own = df.withColumns({"method": F.lit(method), "seed": F.lit(seed)})
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no runs")
    return out

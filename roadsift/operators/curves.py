"""Cumulative sums over a global order by value ranges: no task sees more than a range.

Rows are range-partitioned by the order, each range is summed, the totals of the ranges
before (a row a range, on the driver) are carried into it, and running sums are windows
within a range.  The order must end in a key that parts ties, so that equal scores do not
pile up in one range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Rows of a range, about.
RANGE_ROWS = 500_000
#: Entries of a weight matrix that goes to the executors, and of a task's cumulative matrices.
WEIGHTS, CELLS = 16_000_000, 2_000_000
PART = "__part"


def in_ranges(df: DataFrame, order: Sequence[Column], rows: int | None = None) -> DataFrame:
    """The rows with ``__part``, the number of their range in the order, as a table."""
    parts = max(1, -(-df.count() // (rows or RANGE_ROWS)))
    dealt = df.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()) if parts > 1 else df.withColumn(PART, F.lit(0))
    return written(dealt, "ranges")


def with_running(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column], rows: int | None = None) -> DataFrame:
    """Inclusive running sums (longs) of ``sums`` in the order, as columns of these names."""
    placed = in_ranges(df.withColumns({f"__x_{n}": c.cast("long") for n, c in sums.items()}), order, rows)
    totals = placed.groupBy(PART).agg(*[F.coalesce(F.sum(f"__x_{n}"), F.lit(0)).alias(n) for n in sums]).collect()  # a row a range
    carried, so_far = [], [0] * len(sums)
    for r in sorted(totals, key=lambda r: r[PART]):
        carried.append((r[PART], *so_far))
        so_far = [a + r[n] for a, n in zip(so_far, sums, strict=True)]
    before = df.sparkSession.createDataFrame(carried, ", ".join([f"{PART} int", *[f"`__b_{n}` long" for n in sums]]))
    upto = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = placed.join(F.broadcast(before), PART)
    return met.withColumns({n: F.col(f"__b_{n}") + F.coalesce(F.sum(f"__x_{n}").over(upto), F.lit(0)) for n in sums}).drop(PART, *[f"__{k}_{n}" for n in sums for k in "xb"])


def level_of(recall: Column, levels: int) -> Column:
    """The last of ``levels`` equal steps of recall that is reached."""
    return F.floor(recall * F.lit(float(levels - 1)) + F.lit(1e-9)).cast("int")


def interpolated(best: Mapping[int, float], levels: int) -> float:
    """Mean over the levels of the best precision at this level of recall or beyond; 0 where recall never gets there."""
    high, total = 0.0, 0.0
    for level in range(levels - 1, -1, -1):
        high = max(high, best.get(level, 0.0))
        total += high
    return total / levels


def average_precision(events: DataFrame, n_truth: int, score: str, hit: str, order: str, levels: int = 101) -> float:
    """Interpolated AP: running hits and ranks by ranges, then the best precision of each level."""
    by = [F.col(score).desc(), F.col(order).asc()]
    curve = with_running(events.select(score, order, hit), by, {"__tp": F.coalesce(F.col(hit), F.lit(False)).cast("long"), "__n": F.lit(1)})
    best = curve.groupBy(level_of(F.col("__tp") / F.lit(n_truth), levels).alias("level")).agg(F.max(F.col("__tp") / F.col("__n")).alias("p")).collect()  # at most a row a level
    return interpolated({r["level"]: r["p"] for r in best}, levels)


def rank_sum(df: DataFrame, score: str, positive: str) -> tuple[float, int, int]:
    """Sum of the average ranks of the positives, and the numbers of positives and negatives.  Equal scores are one row before anything is sorted."""
    flag = F.coalesce(F.col(positive), F.lit(False))
    counts = df.groupBy(F.col(score).alias("__s")).agg(F.count_if(flag).alias("p"), F.count(F.lit(1)).alias("c"))
    ranked = with_running(counts, [F.col("__s").asc()], {"upto": F.col("c")})
    row = ranked.agg(F.sum(F.col("p") * (F.col("upto") - (F.col("c") - 1) / 2)), F.sum("p"), F.sum(F.col("c") - F.col("p"))).first()
    return float(row[0] or 0), int(row[1] or 0), int(row[2] or 0)


def weighted_average_precision(events: DataFrame, truth: DataFrame, draws: DataFrame, scene: str, score: str, hit: str, order: str | None = None, levels: int = 101) -> DataFrame:
    """b, ap of every resampling of scenes: ``truth`` (scene, n_truth), ``draws`` (b, scene, weight).

    The events are sorted once.  A range is read with the weights of its scenes in a block
    of replicates, and starts from the weighted totals of the ranges before, which are sums
    of (range, scene) counts times weights; so no replicate makes a copy of the events."""
    spark = events.sparkSession
    tie = [F.col(order).asc()] if order else []
    by = [F.col(score).desc(), F.col(scene).asc(), *tie]
    placed = in_ranges(events.filter(F.col(score).isNotNull()).select(scene, score, F.coalesce(F.col(hit), F.lit(False)).alias(hit), *([order] if order else [])), by)
    names = truth.select(scene).unionByName(placed.select(scene)).distinct().toArrow().column(0).to_pylist()  # the scenes, as in the draws
    place = {s: i for i, s in enumerate(names)}
    counts = placed.groupBy(PART, scene).agg(F.count_if(hit).alias("tp"), F.count(F.lit(1)).alias("n"))
    n_truth = np.zeros(len(names))
    for r in truth.groupBy(scene).agg(F.sum("n_truth").alias("n")).collect():
        n_truth[place[r[scene]]] = r["n"] or 0
    replicates = sorted(r["b"] for r in draws.select("b").distinct().collect())
    block = max(1, WEIGHTS // max(1, len(names)))
    out: list[tuple[int, float | None]] = []
    for at in range(0, len(replicates), block):
        own = replicates[at : at + block]
        weights = np.zeros((len(names), len(own)))
        column = {b: k for k, b in enumerate(own)}
        drawn = draws.filter(F.col("b").between(own[0], own[-1])).groupBy("b", scene).agg(F.sum("weight").alias("w")).toArrow()
        for b, s, w in zip(*(drawn.column(c).to_pylist() for c in ("b", scene, "w")), strict=True):
            if s in place:
                weights[place[s], column[b]] = w
        sizes = weights.T @ n_truth
        best = _best_of_block(placed, counts, weights, place, sizes, [score, scene, *([order] if order else [])], hit, levels)
        out += [(int(b), interpolated(best.get(k, {}), levels) if sizes[k] > 0 else None) for k, b in enumerate(own)]
    return spark.createDataFrame(out, "b long, ap double")


def _best_of_block(placed: DataFrame, counts: DataFrame, weights: np.ndarray, place: dict, sizes: np.ndarray, keys: list[str], hit: str, levels: int) -> dict[int, dict[int, float]]:
    """Best precision at each level of recall, by column of the weights (scenes x replicates)."""
    spark, scene, n_draws = placed.sparkSession, keys[1], weights.shape[1]
    held = spark.sparkContext.broadcast((weights, place, sizes))

    def totals(g: pd.DataFrame) -> pd.DataFrame:
        w, at, _ = held.value
        rows = w[[at[s] for s in g[scene]]]
        return pd.DataFrame({PART: [int(g[PART].iloc[0])], **{c: [(g[c].to_numpy()[:, None] * rows).sum(0).tolist()] for c in ("tp", "n")}})

    of_part = {r[PART]: (np.asarray(r["tp"]), np.asarray(r["n"])) for r in counts.groupBy(PART).applyInPandas(totals, f"{PART} int, tp array<double>, n array<double>").collect()}
    before, so_far = {}, (np.zeros(n_draws), np.zeros(n_draws))
    for part in sorted(of_part):
        before[part] = so_far
        so_far = (so_far[0] + of_part[part][0], so_far[1] + of_part[part][1])
    start = spark.sparkContext.broadcast(before)

    def climb(g: pd.DataFrame) -> pd.DataFrame:
        w, at, truth = held.value
        g = g.sort_values(keys, ascending=[False, *[True] * (len(keys) - 1)], kind="stable")
        code, hits = np.asarray([at[s] for s in g[scene]], np.int64), g[hit].to_numpy(bool)
        tp, n = start.value[int(g[PART].iloc[0])]
        top = np.zeros((levels, n_draws))
        some = max(1, CELLS // n_draws)
        for a in range(0, len(g), some):
            rows = w[code[a : a + some]]
            ctp, cn = tp + np.cumsum(rows * hits[a : a + some, None], axis=0), n + np.cumsum(rows, axis=0)
            tp, n = ctp[-1], cn[-1]
            level = np.floor(ctp / np.maximum(truth, 1) * (levels - 1) + 1e-9).astype(np.int64).clip(0, levels - 1)
            np.maximum.at(top, (level, np.broadcast_to(np.arange(n_draws), level.shape)), ctp / np.maximum(cn, 1))
        i, k = np.nonzero(top)
        return pd.DataFrame({"k": k, "level": i, "p": top[i, k]})

    found = placed.groupBy(PART).applyInPandas(climb, "k long, level int, p double").groupBy("k", "level").agg(F.max("p").alias("p")).toArrow()
    best: dict[int, dict[int, float]] = {}
    for k, level, p in zip(*(found.column(c).to_pylist() for c in ("k", "level", "p")), strict=True):
        best.setdefault(k, {})[level] = p
    return best


def steps(df: DataFrame, order: Sequence[Column], out: str, rows: int | None = None) -> DataFrame:
    """Row number (from 1) in a global order."""
    return with_running(df, order, {out: F.lit(1)}, rows)



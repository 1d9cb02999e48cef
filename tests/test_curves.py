"""Cumulative curves by ranges, bootstrap of AP by weights, and chains by pointer doubling, against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadsift.operators import curves
from roadsift.operators import evaluation as ev
from roadsift.operators.joins import chain_walk


def plain_ap(weights, scores, hits, truth):
    order = np.lexsort((np.arange(len(scores)), -scores))
    tp, n = np.cumsum((weights * hits)[order]), np.cumsum(weights[order])
    levels = [max([t / m for t, m in zip(tp, n, strict=True) if m and t / truth >= k / 100 - 1e-11], default=0.0) for k in range(101)]
    return sum(levels) / 101


def events(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    score, hit, scene = np.round(rng.random(n), 1), rng.random(n) > 0.6, np.sort(rng.integers(0, 12, n))
    rows = [(i, float(score[i]), bool(hit[i]), int(scene[i])) for i in range(n)]
    return spark.createDataFrame(rows, "o long, s double, h boolean, k int").repartition(5), score, hit, scene


@pytest.mark.parametrize("rows", [500_000, 50, 7])
def test_running_sums_and_ap_do_not_depend_on_the_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(curves, "RANGE_ROWS", rows)
    df, score, hit, _ = events(spark, 400 if rows > 7 else 60)
    got = curves.with_running(df, [F.col("s").desc(), F.col("o")], {"tp": F.col("h").cast("long"), "n": F.lit(1)}).orderBy("n").collect()
    order = np.lexsort((np.arange(len(score)), -score))
    assert [r["o"] for r in got] == order.tolist() and [r["n"] for r in got] == list(range(1, len(score) + 1)) and [r["tp"] for r in got] == np.cumsum(hit[order]).tolist()
    truth = int(hit.sum()) + 10
    assert ev.average_precision(df, truth, "s", "h", "o").first()["ap"] == pytest.approx(plain_ap(np.ones(len(score)), score, hit, truth))
    pos, neg = score[hit], score[~hit]
    area = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert ev.auroc(df, "s", "h").first()["auroc"] == pytest.approx(area)
    assert ev.auroc(df.filter("h"), "s", "h").first()["auroc"] == 0.5 and ev.auroc(df.filter("false"), "s", "h").first()["auroc"] == 0.5
    assert ev.average_precision(df.filter("false"), 5, "s", "h", "o").first()["ap"] == 0.0


def test_no_window_over_the_whole_table(spark, capsys):
    df, *_ = events(spark, 50)
    curves.with_running(df, [F.col("s"), F.col("o")], {"n": F.lit(1)}).explain()
    assert "SinglePartition" not in capsys.readouterr().out


@pytest.mark.parametrize(("rows", "weights", "cells"), [(500_000, 16_000_000, 2_000_000), (40, 60, 30)])
def test_bootstrap_of_ap_equals_copies_of_the_events(spark, monkeypatch, rows, weights, cells):
    monkeypatch.setattr(curves, "RANGE_ROWS", rows)
    monkeypatch.setattr(curves, "WEIGHTS", weights)
    monkeypatch.setattr(curves, "CELLS", cells)
    df, score, hit, scene = events(spark, 200, 3)
    truth = {k: int(hit[scene == k].sum()) + 2 for k in range(14)}  # two scenes have no event
    rng = np.random.default_rng(1)
    draws = {b: np.bincount(rng.integers(0, 14, 14), minlength=14) for b in range(9)}
    draws[9] = np.eye(14, dtype=int)[13] * 0
    table = spark.createDataFrame([(b, k, int(w)) for b, ws in draws.items() for k, w in enumerate(ws)], "b long, k int, weight long")
    got = {r["b"]: r["ap"] for r in ev.bootstrap_ap(df, spark.createDataFrame(list(truth.items()), "k int, n_truth long"), table, "k", "s", "h", "o").collect()}
    assert set(got) == set(draws) and got[9] is None
    key = np.lexsort((np.arange(200), scene, -score))
    for b in range(9):
        total = sum(draws[b][k] * truth[k] for k in truth)
        assert got[b] == pytest.approx(plain_ap(draws[b][scene][key], -np.arange(200.0), hit[key], total))


def test_chains_of_all_shapes(spark):
    nodes = [(f"a{k}", f"a{k + 1}" if k < 9 else "") for k in range(10)] + [("b0", "a7"), ("c0", None), ("d0", "d1"), ("d1", "gone")]
    starts = ["a0", "a4", "b0", "c0", "d0", "nowhere"]
    got = {}
    for r in chain_walk(spark, spark.createDataFrame(nodes, "t string, n string"), spark.createDataFrame([(s,) for s in [*starts, "a0"]], "s string"), "t", "n", "s").collect():
        got.setdefault(r["first"], []).append((r["position"], r["token"]))
    follow = {t: n for t, n in nodes if n}
    for s in starts:
        walk, at = [], s
        while at:
            walk.append((len(walk), at))
            at = follow.get(at)
        assert sorted(got[s]) == walk
    assert set(got) == set(starts)
    assert chain_walk(spark, spark.createDataFrame([], "t string, n string"), spark.createDataFrame([("x",)], "s string"), "t", "n", "s").collect() == [("x", "x", 0)]


def test_a_cycle_is_an_error(spark):
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "t long, n long")
    with pytest.raises(ValueError, match="cycle"):
        chain_walk(spark, ring, spark.createDataFrame([(0,)], "s long"), "t", "n", "s")


def test_a_long_chain_takes_few_rounds(spark):
    n = 50_000
    nodes = spark.range(n).select(((F.col("id") * 7919) % n).alias("t"), F.when(F.col("id") < n - 1, ((F.col("id") + 1) * 7919) % n).alias("n"))
    got = chain_walk(spark, nodes, spark.createDataFrame([(0,)], "s long"), "t", "n", "s")
    assert got.filter((F.col("position").cast("long") * 7919) % n == F.col("token")).count() == n

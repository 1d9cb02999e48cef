"""Steps over large tables: bounded parts, ranks and quantiles in ranges, tables that are worked out once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from roadsift.operators import aggregates as agg
from roadsift.operators import curves, greedy, scoring
from roadsift.operators import labels as lab
from roadsift.plans import frames, score_queries


def windows_in_one_task(df):
    return "Window" in (plan := df._jdf.queryExecution().executedPlan().toString()) and "split" in plan.split("Window", 1)[1][:400]


def test_objects_are_dealt_in_bounded_parts(spark, tmp_path, monkeypatch):
    """parts grow with the rows, and columns that are not needed are not shuffled; the objects are the same."""
    rows = [(k % 40, k % 3, k % 7, k % 5, float(k % 4), float(k), 0.1, 0.2, f"d{k % 2}", "A" if k % 2 else "N", "F") for k in range(400)]
    spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(("l_orderkey", "l_linenumber", *frames._FIRST), ("long", "int", "long", "long", "double", "double", "double", "double", "string", "string", "string"), strict=True))).write.parquet(f"{tmp_path}/lineitem.parquet")
    all_ = sorted((r["l_orderkey"], r["l_linenumber"], r["l_partkey"], r["l_suppkey"]) for r in frames.objects(spark, str(tmp_path)).collect())
    monkeypatch.setattr(frames, "TASK_ROWS", 3)
    few = frames.objects(spark, str(tmp_path), ["l_suppkey"])
    assert few.rdd.getNumPartitions() == 134 and few.columns == ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    assert sorted(map(tuple, few.collect())) == all_ and len(all_) == 120


def test_linear_quantiles_in_ranges(spark, monkeypatch):
    """against the aggregate that holds all values of a group, with ties, nulls, a null group and a group without values."""
    monkeypatch.setattr(curves, "RANGE_ROWS", 20)
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *[round(rng.random() * 30) / 4 for _ in range(6)]])) for _ in range(500)] + [("c", None), ("d", 1.5)]
    df = spark.createDataFrame(rows, "g string, x double")
    qs = {"q0": 0.0, "q20": 0.2, "q50": 0.5, "q97": 0.97, "q100": 1.0}
    want = {r["g"]: list(r)[1:] for r in df.groupBy("g").agg(*[F.percentile("x", F.lit(q)) for q in qs.values()]).collect()}
    got = {r["g"]: list(r)[1:] for r in agg.quantiles_linear(df, "g", "x", qs).collect()}
    assert got.keys() == want.keys() and got["c"] == [None] * 5
    assert all(got[g] == pytest.approx(want[g]) for g in want if g != "c")


def test_image_ranks_have_no_window_over_a_split(spark):
    """a split of any size is ranked in sorted ranges."""
    rows = [(f"f{k // 2}", "CAM_FRONT" if k % 2 else "CAM_BACK", "s", "pool", 0, float(k % 9), None if k % 10 == 3 else float(k), 1.0, "q", k % 4 > 0, 1) for k in range(60)]
    df = spark.createDataFrame(rows, "sample_token string, cam string, scene_token string, split string, frame_idx int, nov_knn double, unc double, qry_max double, qry_best string, q_ok boolean, det_n_conf int")
    out = scoring.image_scores(df, (0.4, 0.3, 0.3))
    assert not windows_in_one_task(out)
    values = sorted(r["unc"] for r in out.collect() if r["q_ok"] and r["unc"] is not None)
    for r in out.collect():
        want = (values.index(r["unc"]) + 1) / len(values) if r["q_ok"] and r["unc"] is not None else 0.0
        assert r["r_unc"] == pytest.approx(want)
        assert r["r_qry"] == pytest.approx((45 + 1) / 2 / 45 if r["q_ok"] else 0.0)


def counted(df, seen):
    def note(batches):
        for b in batches:
            seen.add(b.num_rows)  # an accumulator
            yield b

    return df.mapInArrow(note, df.schema)


def test_inputs_of_statistics_are_read_once(spark):
    """every row of the objects is worked out once, however many statistics and rounds read them."""
    seen = spark.sparkContext.accumulator(0)
    boxes = spark.createDataFrame([(f"f{k % 20}", f"t{k % 7}", "ab"[k % 2], float(k % 11), k % 5) for k in range(80)], "sample_token string, instance_token string, vru_group string, dist_m double, num_lidar_pts int")
    marks = spark.createDataFrame([(f"f{k}", "V" if k % 2 else "pool") for k in range(20)], "sample_token string, split string")
    assert lab.surprisal_labels(counted(boxes, seen), marks).count() == 20
    assert seen.value == 80
    frames_seen = spark.sparkContext.accumulator(0)
    tokens = counted(spark.createDataFrame([(k,) for k in range(12)], "token long"), frames_seen)
    covers = spark.createDataFrame([(k, j) for k in range(12) for j in range(k)], "token long, inst long")
    list(greedy.max_cover(covers, tokens, 4, 2))
    assert frames_seen.value == 12


def test_events_of_average_precision_are_stored(spark):
    """the ranked events are a table, not the objects' window again for every statistic."""
    plan = score_queries._ap_events(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "ranked-events" in plan

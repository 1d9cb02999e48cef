from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadsift import params
from roadsift.functions import geometry as g
from roadsift.functions import scalars as s
from roadsift.functions.ranks import pct_rank, with_pct_rank
from roadsift.schemas import CONTRACTS, ContractError, validate


def values(df, column):
    return [r[column] for r in df.collect()]


def test_pct_rank_hand_values(spark):
    df = spark.createDataFrame([(0, 5.0, True), (1, 7.0, True), (2, 9.0, True), (3, 8.0, False), (4, None, True)], "i int, x double, m boolean")
    assert values(df.withColumn("r", pct_rank(F.col("x"), F.col("m"))).orderBy("i"), "r") == pytest.approx([1 / 3, 2 / 3, 1, 0, 0])
    same = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert values(same.withColumn("r", pct_rank(F.col("x"))), "r") == [0, 0]
    assert values(same.withColumn("r", pct_rank(F.col("x"), constant_is_zero=False)), "r") == [0.75, 0.75]


def test_global_rank_by_ranges_equals_one_window(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, float(v) if i % 9 else None, bool(i % 4)) for i, v in enumerate(rng.integers(0, 60, 500))], "i int, x double, m boolean")
    a = with_pct_rank(df, "x", "r", "m").orderBy("i")
    b = with_pct_rank(df, "x", "r", "m", single_rows=0, ranges=7).orderBy("i")
    assert values(a, "r") == pytest.approx(values(b, "r"))


def test_exact_percentiles_by_brackets(spark):
    from roadsift.operators.aggregates import exact_percentiles

    rng = np.random.default_rng(1)
    for x in (rng.normal(0, 1, 3000), np.round(rng.normal(0, 1, 3000)), np.ones(50)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
        qs = [0.0, 0.01, 0.5, 0.9, 1.0]
        assert exact_percentiles(df, "x", qs, single_rows=10, margin=0.02) == pytest.approx(list(np.percentile(x, [100 * q for q in qs])))
    assert exact_percentiles(df.limit(0), "x", [0.5]) == [None]


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    assert get(s.relative_change(F.lit(4.0), F.lit(2.0))) == 0.5
    assert get(s.binary_entropy(F.lit(0.5))) == pytest.approx(1)
    assert get(s.binary_entropy(F.lit(0.5), bits=False)) == pytest.approx(math.log(2))
    assert get(s.surprisal(F.lit(None).cast("double"))) == float("inf")
    assert get(s.bin_right(F.lit(20.0), [0, 20, 40, 1000], clip=True)) == 1
    assert get(s.bin_right(F.lit(5000.0), [0, 20, 40, 1000], clip=True)) == 2
    assert get(s.equal_width_bin(F.lit(1.0), 20)) == 20
    assert get(s.slug(F.lit("  A crowd, at Night! "))) == "a_crowd_at_night"
    assert get(s.slug(F.lit("!!!"))) == "query"
    assert get(s.pipe_split(F.lit("a||b"))) == ["a", "b"]
    assert get(s.top2_margin(F.array(F.lit(0.2), F.lit(0.7), F.lit(0.1)))) == pytest.approx(0.5)
    assert get(s.softmax(F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx([0.5, 0.5])
    assert get(s.parse_size(F.lit("50MB"))) == 50 * 1024 * 1024
    assert get(s.scene_range(F.lit("3..5, 12"))) == ["scene-0003", "scene-0004", "scene-0005", "scene-0012"]
    assert get(s.top_reasons([("a", F.lit(0.95)), ("b", F.lit(0.99)), ("c", F.lit(0.5))])) == "b p99 · a p95"
    assert get(s.arg_max_reason([("a", F.lit(0.3)), ("b", F.lit(0.875))])) == "b p88"
    assert get(s.size_class(F.lit(0.8), F.lit(0.6), F.lit(1.7), [("pedestrian", 1.2, 1.2, 0.8, 2.2), ("bicycle", 2.5, 1.0, 0.5, 2.0)])) == "pedestrian"
    assert get(s.tags_from([("R1", F.lit(True)), ("R2", F.lit(False)), ("H", F.lit(True))])) == ["R1", "H"]
    # noon sun at the equator near the equinox stands high; midnight is far below the horizon
    equinox = 1_711_015_200_000_000  # 2024-03-21 10:00 UTC
    assert get(s.sun_elevation(F.lit(equinox + 2 * 3_600_000_000), F.lit(0.0), F.lit(0.0))) > 85
    assert get(s.sun_elevation(F.lit(equinox + 14 * 3_600_000_000), F.lit(0.0), F.lit(0.0))) < -80


def test_geometry(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    half = math.sqrt(0.5)
    q = F.array(*[F.lit(x) for x in (half, 0.0, 0.0, half)])  # 90 degrees about z
    p, t = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.array(F.lit(10.0), F.lit(0.0), F.lit(0.0))
    assert get(g.yaw(q)) == pytest.approx(math.pi / 2)
    assert get(g.to_parent(p, q, t)) == pytest.approx([8, 1, 3])
    assert get(g.to_child(g.to_parent(p, q, t), q, t)) == pytest.approx([1, 2, 3])
    rel_q, rel_t = g.relative_pose(q, t, q, g.to_parent(p, q, t))
    assert get(rel_q) == pytest.approx([1, 0, 0, 0]) and get(rel_t) == pytest.approx([1, 2, 3])
    corners = get(g.box_corners(t, F.array(F.lit(2.0), F.lit(4.0), F.lit(1.0)), q))
    assert len(corners) == 8 and corners[0] == pytest.approx([9, 2, 0.5])
    assert get(g.pixel(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)), F.array(*[F.lit(float(x)) for x in (100, 0, 50, 0, 100, 60, 0, 0, 1)]))) == pytest.approx([75, 110, 4])
    box = lambda *v: [F.lit(float(x)) for x in v]
    assert get(g.iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert get(g.iou(box(0, 0, 1, 1), box(2, 2, 3, 3))) == 0
    assert get(g.angle_error(F.lit(0.1), F.lit(math.pi - 0.1))) == pytest.approx(0.2)
    assert get(g.in_rotated_box(F.array(F.lit(10.9), F.lit(1.9), F.lit(0.4)), t, F.array(F.lit(2.0), F.lit(4.0), F.lit(1.0)), q))


def test_parameters():
    assert params.budget_frames(100, 0.07) == 7 and params.budget_frames(0, 0.05) == 0 and params.budget_frames(3, 0.01) == 1
    p = params.resolve_camera(budget=0.5, alpha=2, beta=2, gamma=4)
    assert p.budget == 0.10 and p.weights == (0.25, 0.25, 0.5) and p.lam == 0.7
    with pytest.raises(params.ParameterError):
        params.resolve_camera(preset="none")
    q, warnings = params.resolve_lidar(alpha=1, beta=1)
    assert q.weights == (1, 0, 0) and warnings
    assert params.without_novelty((0.5, 0.25, 0.25))[0] == pytest.approx((2 / 3, 0, 1 / 3))
    assert params.selection_id(p, [("a", 1, 2)]) == params.selection_id(p, [("a", 1, 2)]) != params.selection_id(p, [("a", 1, 3)])
    assert params.overlay({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_contracts(spark):
    assert len(CONTRACTS) == 27
    good = spark.createDataFrame([("s", 0.5, 0.1, 3, 0.2, "extra")], "sample_token string, ent double, inc double, n_det int, nov double, more string")
    assert validate(good, "t1_signals").columns == ["sample_token", "ent", "inc", "n_det", "nov"]
    for bad in (good.union(good), good.withColumn("ent", F.lit(float("nan"))), good.drop("nov")):
        with pytest.raises(ContractError):
            validate(bad, "t1_signals")


def test_parameter_domains_and_schema():
    for bad in ({"lam": 1.5}, {"lam": -0.1}, {"k": 2}, {"k": 51}, {"tier": 1}, {"preset": "none"}, {"diversity": "none"}, {"alpha": -1.0, "beta": 2.0}, {"alpha": 0.0, "beta": 0.0}):
        with pytest.raises(params.ParameterError):
            params.resolve_lidar(**bad)
    p, warnings = params.resolve_lidar(tiers=(0, 1), preset="rare_first", lam=0.0, k=3, quota_off=True)
    assert (p.tier, p.weights, p.lam, p.k, p.per_scene, warnings) == (1, (0.8, 0.1, 0.1), 0.0, 3, None, [])
    p, warnings = params.resolve_lidar(preset="hard_for_model")
    assert p.weights == (1.0, 0.0, 0.0) and not warnings
    schema = params.params_schema((0, 1))
    fields = {f["key"]: f for f in schema["fields"]}
    assert list(fields) == ["tier", "k", "lam", "maxPerScene", "quotaOff", "alpha", "beta", "gamma"]
    assert (fields["k"]["min"], fields["k"]["max"], fields["tier"]["default"], schema["tierAvailable"]) == (3, 50, 1, [0, 1])

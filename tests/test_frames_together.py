"""Matching within frames, many frames at a time, against the plain loop over one frame's boxes."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadsift.operators import kernels
from roadsift.operators import matching as mt
from roadsift.plans import candidate_queries as cq


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def overlap(a, b) -> float:
    w, h = (max(0.0, min(a[k + 2], b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return w * h / max(area(a) + area(b) - w * h, 1e-9)


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("lines")
    rng = random.Random(4)
    rows = [(k // 6, k % 6 + 1, rng.randrange(99), 1, float(rng.randrange(50)), float(rng.randrange(90)), rng.randrange(10) / 100, rng.randrange(8) / 100, "d", rng.choice("ANR"), "F") for k in range(600) if rng.random() < 0.9]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate string, l_returnflag string, l_linestatus string").write.parquet(f"{d}/lineitem.parquet")
    return str(d)


@pytest.mark.parametrize("rounds", [64, 1, 0])
def test_first_pairs_are_those_of_the_plain_loop(rounds):
    rng = random.Random(1)
    for _ in range(30):
        pairs = list({(rng.randrange(9), 9 + rng.randrange(9)) for _ in range(30)})
        used, want = set(), []
        for i, j in pairs:
            want.append(i not in used and j not in used)
            used |= {i, j} if want[-1] else set()
        assert kernels.first_pairs(*np.array(pairs).T, 18, rounds).tolist() == want


@pytest.mark.parametrize("pairs", [1 << 20, 3])
def test_pairs_are_weighed_in_bounded_steps(monkeypatch, pairs):
    import pyarrow as pa

    monkeypatch.setattr(mt, "PAIRS", pairs)
    table = pa.table({"f": [1] * 5 + [2] * 3 + [None] * 4 + [3], "__k": [1, 2, 3, 4, 5, 1, 2, 3, 1, 2, 3, 4, 1], "__b": [False, False, True, True, True, False, True, True, False, False, True, True, True]})
    f = mt.Frames(table, ["f"])
    most = []
    i, j, _ = f.close(lambda i, j: most.append(len(i)) or np.ones(len(i)), lambda w: w > 0)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 2), (0, 3), (0, 4), (1, 2), (1, 3), (1, 4), (5, 6), (5, 7)]
    assert max(most) <= max(pairs, 3) + 3 and f.n_a.tolist() == [2, 1, 2, 0, 0] and f.n_b.tolist() == [3, 2, 0, 2, 1]


def test_merging_reads_the_objects_once(spark, lines):
    """one deal of the boxes by frame; no arrays of a frame and no join of sides."""
    out = cq.merged_candidates(spark, lines)
    plan = plan_of(out)
    assert plan.count("Scan parquet") == 1 and "collect_list" not in plan and "Join" not in plan
    boxes = cq._coarse(spark, lines).withColumn("pts", F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise(F.col("pts"))).collect()
    want = []
    for f, rows in itertools.groupby(sorted(boxes, key=lambda r: (r["sample_token"], r["cx"], r["cy"], r["w"], r["pts"], r["cls_pred"])), key=lambda r: r["sample_token"]):
        rows = list(rows)
        a, b = ([r for r in rows if r["l_linenumber"] % 2 == k] for k in (1, 0))
        side = lambda r: (r["cx"] - r["l"] / 2, r["cy"] - r["w"] / 2, r["cx"] + r["l"] / 2, r["cy"] + r["w"] / 2)
        of, left = {}, set(range(len(a)))
        for _, i, j in sorted((-v, i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (v := overlap(side(x), side(y))) >= 0.3):
            if i in left and j not in of:
                left.discard(i)
                of[j] = i
        row = lambda r, pts, source: (f, r["cx"], r["cy"], r["w"], pts, r["cls_pred"], source, source == "cluster")
        want += [row(r, a[of[j]]["pts"] if j in of else 0, "merged" if j in of else "detector") for j, r in enumerate(b)] + [row(a[i], a[i]["pts"], "cluster") for i in left]
    got = [tuple(r[c] for c in ("sample_token", "cx", "cy", "w", "pts", "cls_pred", "source", "missed_by_model")) for r in out.collect()]
    assert sorted(got) == sorted(want) and {r[6] for r in want} == {"merged", "cluster", "detector"}


def test_frames_over_many_batches(spark, lines):
    """a frame may lie in several batches, and the two forms of the operator agree."""
    g = cq._coarse(spark, lines)
    even = F.col("l_linenumber") % 2 == 0
    one = sorted(map(tuple, mt.merge_flagged(g, even).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert sorted(map(tuple, mt.merge_flagged(g, even).collect())) == one
        assert sorted(map(tuple, mt.merge_candidates(g.filter(~even), g.filter(even)).collect())) == one
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hits_read_the_objects_once(spark, lines):
    """one deal of the boxes by frame, with the hits of the plain loop over detections."""
    out = cq.detection_hits(spark, lines)
    plan = plan_of(out)
    assert plan.count("Scan parquet") == 1 and "collect_list" not in plan and "Join" not in plan
    want = []
    of_frame = lambda r: r["sample_token"]
    for f, rows in itertools.groupby(sorted(cq._coarse(spark, lines).collect(), key=of_frame), key=of_frame):
        side = lambda r: (r["cx"] - 3, r["cy"] - r["w"] / 2, r["cx"] + 3, r["cy"] + r["w"] / 2)
        rows = list(rows)
        dets = sorted((-r["score"], *side(r)) for r in rows if r["l_linenumber"] % 2 == 0)
        free = sorted((*side(r), r["pts"] < 20) for r in rows if r["l_linenumber"] % 2)
        for d in dets:
            near = [(-v, k) for k, x in enumerate(free) if (v := overlap(d[1:], x[:4])) >= 0.4]
            real = sorted(x for x in near if not free[x[1]][4])
            if real or not near:
                want.append((f, -d[0], bool(real)))
            if real:
                free.pop(real[0][1])
    got = [tuple(r) for r in out.collect()]
    assert sorted(got) == sorted(want) and {r[2] for r in want} == {True, False}

"""Frame tags: what is stored on the way, and that evidence changes nothing else."""

from __future__ import annotations

from roadsift.operators import scoring as sc
from roadsift.plans import score_queries as q

SMALL = "/root/testdata/sf0.001"


def test_frame_tags_store_objects_once_and_sort_none(spark, monkeypatch):
    """objects are stored once, without columns that no tag reads, and are hashed by frame; with evidence the tags are the same."""
    plans = {}
    real = sc.written

    def noted(df, name):
        plans[name] = (df.columns, df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(sc, "written", noted)
    got = sorted(map(tuple, q.frame_rhcio_tags(spark, SMALL).collect()))
    assert "celled" not in plans and "object_id" not in plans["objects"][0]
    assert "HashAggregate" in plans["frame-signals"][1] and "SortAggregate" not in plans["frame-signals"][1]
    tags = sc.frame_tags
    monkeypatch.setattr(sc, "frame_tags", lambda objects, *a, evidence: tags(objects.withColumn("object_id", objects["pts"].cast("string")), *a))
    assert sorted(map(tuple, q.frame_rhcio_tags(spark, SMALL).collect())) == got
    assert "SortAggregate" in plans["frame-signals"][1]


def test_bins_by_comparisons(spark):
    """as many edges as are at or below the value, of none, one or three edges; nulls are in the first bin."""
    rows = [("a", 1.0, 5), ("a", 2.5, 7), ("a", None, 9), ("b", 4.0, 1), ("c", 1.0, 1)]
    edges = [("a", [1.0, 2.0, 3.0], [5.0, 7.0, 8.0]), ("b", [4.0], [2.0])]
    met = sc.with_cells(spark.createDataFrame(rows, "cls_pred string, dist_m double, pts int"), spark.createDataFrame(edges, "cls_pred string, dist_m_edges array<double>, pts_edges array<double>"), "cls_pred")
    assert sorted(r["cell"] for r in met.collect()) == ["a|d0|p3", "a|d1|p1", "a|d2|p2", "b|d1|p0", "c|d0|p0"]

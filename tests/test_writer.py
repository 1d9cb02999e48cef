from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from test_sources import write_dataset

from roadsift import cli
from roadsift.plans import views
from roadsift.schemas import ContractError
from roadsift.sources import metadata, writer


def test_metadata_round_trip(spark, tmp_path):
    write_dataset(str(tmp_path / "in"))
    t = metadata.load_tables(spark, str(tmp_path / "in"))
    t = {k: v for k, v in t.items() if k not in ("visibility", "attribute")}
    out = writer.with_links(t)
    writer.write_metadata(spark, out, str(tmp_path / "out"))
    back = metadata.load_tables(spark, str(tmp_path / "out"))
    metadata.check_chains(spark, back)
    assert {k: back[k].count() for k in t} == {k: t[k].count() for k in t}
    a, b = ({r["token"]: (r["prev"], r["next"]) for r in x["sample"].collect()} for x in (t, back))
    assert a == b and os.path.exists(tmp_path / "out/report.json")
    ann = {r["token"]: r["next"] for r in back["sample_annotation"].collect()}
    assert ann["ann-s0f0"] == "ann-s0f1" and ann["ann-s0f5"] == ""
    with pytest.raises(ContractError):
        writer.write_metadata(spark, out, str(tmp_path / "out"))
    with pytest.raises(ContractError):
        writer.check_tables(out | {"scene": out["scene"].limit(1)})
    assert writer.with_tokens(t["log"].drop("token"), "logfile").first()["token"]


def test_export_index(spark):
    f = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.4), ("c", 3, 0.1)], "sample_token string, rank int, s double")
    m = spark.createDataFrame([("a", "x", "p1"), ("a", "y", "p2"), ("b", "x", "p3"), ("c", "x", "p4")], "sample_token string, cam string, img_path string")
    rows = views.export_index(f, m, spark.createDataFrame([("p1",), ("p3",)], "filename string"), 2).collect()
    assert [(r["sample_token"], r["images"], r["missing"]) for r in rows] == [("a", ["p1"], "p2"), ("b", ["p3"], "")] and '"rank":1' in rows[0]["meta"]


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "frame_topk_quota" in capsys.readouterr().out
    assert cli.main(["run", "nope", "x", "y"]) == 2
    assert cli.main(["run", "set_ops", "/root/testdata/sf0.001", str(tmp_path / "o"), "--format", "json"]) == 0
    assert spark.read.json(str(tmp_path / "o")).select(F.col("n_both")).count() == 1

"""Writing metadata: JSON-array tables in a versioned folder, with derived tokens and links, published by one rename."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.adapters import hashed_token
from ..operators.splits import linked
from ..schemas import ContractError, duplicate_keys
from .metadata import OPTIONAL, REQUIRED, load_tables
from .tables import _fs, write_json

#: Columns that point to another table: table, column, target.
LINKS = (
    ("scene", "log_token", "log"), ("sample", "scene_token", "scene"), ("sample_data", "sample_token", "sample"), ("sample_data", "ego_pose_token", "ego_pose"), ("sample_data", "calibrated_sensor_token", "calibrated_sensor"),
    ("calibrated_sensor", "sensor_token", "sensor"), ("instance", "category_token", "category"), ("sample_annotation", "sample_token", "sample"), ("sample_annotation", "instance_token", "instance"),
)


def with_tokens(df: DataFrame, *key: str) -> DataFrame:
    """A token column from the natural key."""
    return df.withColumn("token", hashed_token(*key))


def with_links(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """prev and next of samples (along their scene), of media (along their sensor) and of annotations (along their instance)."""
    t = dict(tables)
    t["sample"] = linked(t["sample"], ["scene_token"], ["timestamp", "token"])
    scene = t["sample"].select(F.col("token").alias("sample_token"), F.col("scene_token").alias("__scene"), F.col("timestamp").alias("__t"))
    t["sample_data"] = linked(t["sample_data"].join(scene.select("sample_token", "__scene"), "sample_token"), ["__scene", "calibrated_sensor_token"], ["timestamp", "token"]).drop("__scene")
    if "sample_annotation" in t:
        t["sample_annotation"] = linked(t["sample_annotation"].join(scene.select("sample_token", "__t"), "sample_token"), ["instance_token"], ["__t", "token"]).drop("__t")
    return t


def check_tables(tables: Mapping[str, DataFrame]) -> None:
    """Required tables, unique tokens and no dangling references; raises ContractError."""
    if lost := [t for t in REQUIRED if t not in tables]:
        raise ContractError(f"tables missing: {', '.join(lost)}")
    for name, df in tables.items():
        if not duplicate_keys(df, ("token",)).isEmpty():
            raise ContractError(f"{name}: duplicate tokens")
    for name, column, target in LINKS:
        if name in tables and target in tables:
            lost_rows = tables[name].select(F.col(column).alias("token")).filter("token is not null and token <> ''").join(tables[target].select("token"), "token", "left_anti")
            if not lost_rows.isEmpty():
                raise ContractError(f"{name}.{column} points to nothing in {target}")


def _array(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    first = True
    for b in batches:
        for row in b["value"]:
            yield pd.DataFrame({"value": ["[" + row if first else "," + row]})
            first = False
    yield pd.DataFrame({"value": ["[]" if first else "]"]})


def write_metadata(spark: SparkSession, tables: Mapping[str, DataFrame], root: str, version: str = "v1.0-roadsift", report: Mapping[str, object] | None = None) -> None:
    """Writes every table as one JSON array (streamed by a single task), checks the copy by reading it back, then renames it into place."""
    check_tables(tables)
    tmp = f"{root.rstrip('/')}/tmp-{uuid.uuid4().hex[:8]}"
    schemas = REQUIRED | OPTIONAL
    for name, df in tables.items():
        columns = [c.split(" ", 1)[0] for c in schemas[name].split(", ")]
        body = df.select(F.to_json(F.struct(*[c for c in columns if c in df.columns]), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).mapInPandas(_array, "value string")
        body.write.text(f"{tmp}/{version}/{name}.parts")
        folder, fs = _fs(spark, f"{tmp}/{version}/{name}.parts")
        part = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
        fs.rename(part, _fs(spark, f"{tmp}/{version}/{name}.json")[0])
        fs.delete(folder, True)
    back = load_tables(spark, tmp)
    counts = {name: back[name].count() for name in tables}
    if bad := [n for n, df in tables.items() if df.count() != counts[n]]:
        raise ContractError(f"written tables differ: {', '.join(bad)}")
    src, fs = _fs(spark, f"{tmp}/{version}")
    dst, _ = _fs(spark, f"{root.rstrip('/')}/{version}")
    if fs.exists(dst):
        raise ContractError(f"{version} exists already")
    fs.rename(src, dst)
    fs.delete(_fs(spark, tmp)[0], True)
    write_json(spark, {"version": version, "rows": counts} | dict(report or {}), f"{root.rstrip('/')}/report.json")

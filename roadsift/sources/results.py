"""The catalogue of stored selections, and the choice among experiment folders: scans of file metadata."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import _fs, write_json

ID = "^[0-9a-f]{12}$"
#: The document that completes a selection's folder: it is written last.
RESULT = "result.json"


class NotThereError(KeyError):
    """No stored result has this id."""


def store_selection(spark: SparkSession, root: str, sid: str, selected: DataFrame, params: dict[str, object], **result: object) -> str:
    """Writes ``<root>/<sid>``: the selected rows first, the result document last, so a half-written folder is no selection."""
    if not re.match(ID, sid):
        raise ValueError(f"not a selection id: {sid!r}")
    folder = f"{root.rstrip('/')}/{sid}"
    selected.write.mode("overwrite").parquet(f"{folder}/selected.parquet")
    write_json(spark, {"selection_id": sid, "params": params} | result, f"{folder}/{RESULT}")
    return folder


def list_selections(spark: SparkSession, root: str) -> DataFrame:
    """selection_id, created_at, params (JSON text) of ``<root>/<id>/result.json``, newest first, ties by falling id.

    Folders whose name is no id, and results that are no JSON object, do not count; params
    that are no object are an empty one."""
    path, fs = _fs(spark, f"{root.rstrip('/')}/*/{RESULT}")
    if not fs.globStatus(path):
        return spark.createDataFrame([], "selection_id string, created_at timestamp, params string")
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/{RESULT}")
    found = files.select(F.element_at(F.split("path", "/"), -2).alias("selection_id"), F.col("modificationTime").alias("created_at"), F.trim(F.col("content").cast("string")).alias("t"))
    params = F.get_json_object("t", "$.params")
    good = found.filter(F.col("selection_id").rlike(ID) & F.try_parse_json("t").isNotNull() & F.col("t").startswith("{"))
    return good.select("selection_id", "created_at", F.when(params.startswith("{"), params).otherwise(F.lit("{}")).alias("params")).orderBy(F.col("created_at").desc(), F.col("selection_id").desc())


def get_selection(spark: SparkSession, root: str, sid: str) -> tuple[str, DataFrame]:
    """The result document and the selected rows of an id; an id that is none, or is not stored, raises ``NotThereError``."""
    path, fs = _fs(spark, f"{root.rstrip('/')}/{sid}/{RESULT}")
    if not re.match(ID, sid) or not fs.exists(path):
        raise NotThereError(sid)
    text = spark.read.text(f"{root.rstrip('/')}/{sid}/{RESULT}", wholetext=True).first()[0]
    return text, spark.read.parquet(f"{root.rstrip('/')}/{sid}/selected.parquet")


def stale(spark: SparkSession, folder: str, inputs: Sequence[str], made: str = RESULT) -> bool:
    """Whether a stored result is missing or older than one of its inputs."""
    path, fs = _fs(spark, f"{folder.rstrip('/')}/{made}")
    if not fs.exists(path):
        return True
    when = fs.getFileStatus(path).getModificationTime()
    times = [(f.exists(p) and f.getFileStatus(p).getModificationTime()) for p, f in (_fs(spark, i) for i in inputs)]
    return any(t is False or t > when for t in times)


def first_complete(spark: SparkSession, folders: Sequence[str], needed: Sequence[str], version: str | None, version_of: str = "config.json") -> tuple[str | None, str]:
    """The first folder that has all needed files and, where a version is asked for, carries it; or None and the reason."""
    exists = lambda p: _fs(spark, p)[1].exists(_fs(spark, p)[0])
    lacking = {f: [n for n in needed if not exists(f"{f.rstrip('/')}/{n}")] for f in folders}
    complete = [f for f in folders if not lacking[f]]
    if not complete:
        return None, "missing: " + ", ".join(f"{f.rstrip('/')}/{n}" for f in folders for n in lacking[f])
    if version is None:
        return complete[0], ""
    own: dict[str, str | None] = {}
    for f in complete:
        where = f"{f.rstrip('/')}/{version_of}"
        own[f] = spark.read.text(where, wholetext=True).select(F.get_json_object("value", "$.version")).first()[0] if exists(where) else None
        if own[f] == version:
            return f, ""
    return None, f"no model for {version} (there is " + ", ".join(f"{f.rstrip('/').split('/')[-1]} = {v}" for f, v in own.items()) + ")"

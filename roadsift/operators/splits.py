"""Splits, freezing, sub-datasets and part planning."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ContractError
from ..scratch import written
from .joins import require_none

ENGINE_SPLIT = {"CAL": "V", "POOL": "T", "EVAL": "P"}


def hash_split(scenes: DataFrame, name: str, seed: int, first: float = 0.20, last: float = 0.25) -> DataFrame:
    """CAL, POOL and EVAL by the order of sha1(name|seed): the first and last shares, rounded half to even."""
    w = Window.partitionBy().orderBy(F.sha1(F.concat_ws("|", F.col(name), F.lit(str(seed)))), F.col(name))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rank = F.row_number().over(w)
    split = F.when(rank <= F.bround(n * F.lit(first)), F.lit("CAL")).when(rank > n - F.bround(n * F.lit(last)), F.lit("EVAL")).otherwise(F.lit("POOL"))
    out = scenes.withColumn("bench_split", split)
    return out.withColumn("engine_split", F.create_map(*[F.lit(x) for kv in ENGINE_SPLIT.items() for x in kv])[F.col("bench_split")])


def plan_splits(train: Sequence[str], seed: int, s_share: float, v_scenes: int, fixed: Mapping[str, str] | None = None) -> dict[str, str]:
    """Scene name to split: fixed names first, then a seeded permutation of the training scenes into S, V and the rest P."""
    fixed = dict(fixed or {})
    free = [n for n in sorted(train) if n not in fixed]
    order = [free[i] for i in np.random.default_rng(seed).permutation(len(free))]
    n_s = max(1, round(s_share * len(free))) if free else 0
    plan = {n: "S" for n in order[:n_s]} | {n: "V" for n in order[n_s : n_s + v_scenes]} | {n: "P" for n in order[n_s + v_scenes :]}
    return plan | fixed


def assign_splits(index: DataFrame, plan: Mapping[str, str], name: str = "scene_name", default: str = "pool") -> DataFrame:
    """Split of every row; unknown scenes go to the default."""
    table = index.sparkSession.createDataFrame(list(plan.items()) or [("", default)], f"{name} string, __split string")
    return index.drop("split").join(F.broadcast(table), name, "left").withColumn("split", F.coalesce("__split", F.lit(default))).drop("__split")


def check_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    require_none(a.select(key).join(b.select(key), key, "left_semi"), "in both")


def check_one_scene(instances: DataFrame, instance: str, scene: str) -> None:
    require_none(instances.groupBy(instance).agg(F.count_distinct(scene).alias("n")).filter("n > 1"), "instances in several scenes")


def independent(selector: Sequence[str], judge: Sequence[str]) -> None:
    """Model families of selector and judge must both be declared and disjoint."""
    if not selector or not judge or set(selector) & set(judge):
        raise ContractError("selector and judge must have declared, disjoint families")


def sub_dataset(tables: Mapping[str, DataFrame], scenes: DataFrame) -> dict[str, DataFrame]:
    """Tables reachable from the chosen scenes by a chain of semi-joins; links that leave the subset become empty."""
    t = dict(tables)
    semi = lambda df, by, other, key="token": df.join(other.select(F.col(key).alias(by)).distinct(), by, "left_semi")
    t["scene"] = t["scene"].join(scenes.select("name").distinct(), "name", "left_semi")
    t["sample"] = semi(t["sample"], "scene_token", t["scene"])
    t["sample_data"] = semi(t["sample_data"], "sample_token", t["sample"])
    for table, by in (("ego_pose", "ego_pose_token"), ("calibrated_sensor", "calibrated_sensor_token")):
        if table in t:
            t[table] = semi(t[table], "token", t["sample_data"], by)
    if "sample_annotation" in t:
        t["sample_annotation"] = semi(t["sample_annotation"], "sample_token", t["sample"])
        if "instance" in t:
            t["instance"] = semi(t["instance"], "token", t["sample_annotation"], "instance_token")
    for table in ("sample", "sample_data", "sample_annotation"):
        if table in t and "next" in t[table].columns:
            t[table] = without_dangling(t[table])
    return t


def without_dangling(df: DataFrame, links: Sequence[str] = ("prev", "next")) -> DataFrame:
    own = df.select("token").distinct()
    for link in links:
        there = own.select(F.col("token").alias(link), F.lit(True).alias(f"__{link}"))
        df = df.join(there, link, "left").withColumn(link, F.when(F.col(f"__{link}"), F.col(link)).otherwise(F.lit(""))).drop(f"__{link}")
    return df


def linked(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """prev and next tokens along each group, empty at the ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({"prev": F.coalesce(F.lag("token").over(w), F.lit("")), "next": F.coalesce(F.lead("token").over(w), F.lit(""))})


def keyframes(sweeps: DataFrame, log: str, time: str, every: int = 5) -> DataFrame:
    """Every k-th sweep is a keyframe; sample number is the sweep number div k."""
    i = F.row_number().over(Window.partitionBy(log).orderBy(time)) - 1
    return sweeps.withColumn("__i", i).withColumns({"is_key_frame": F.col("__i") % every == 0, "sample_idx": F.floor(F.col("__i") / every).cast("int")}).drop("__i")


def plan_parts(groups: Sequence[tuple[str, int]], limit: int) -> list[list[str]]:
    """Sequential packing in the given order: a group opens a new part when it does not fit the open one; an oversize group has a part of its own."""
    parts: list[list[str]] = []
    room = 0
    for name, size in groups:
        if not parts or size > room:
            parts.append([])
            room = limit
        parts[-1].append(name)
        room -= size
    return parts


def closure_depth(spark, frames: DataFrame, most: int = 9) -> DataFrame:  # type: ignore[no-untyped-def]
    """Predecessors of every keyframe up to a depth: token, ancestor, depth.

    A join a step, each stored (a recursive query ends with an error at a million rows)."""
    known = written(frames.select("token", "prev", "scene_token"), "closure")
    level = known.select("token", F.col("token").alias("ancestor"), F.lit(0).alias("depth"), "scene_token", F.col("prev").alias("following"))
    out = level.select("token", "ancestor", "depth")
    earlier = known.select(F.col("token").alias("following"), F.col("prev").alias("__next"), "scene_token")
    for depth in range(1, most + 1):
        up = level.join(earlier, ["following", "scene_token"])
        level = written(up.select("token", F.col("following").alias("ancestor"), F.lit(depth).alias("depth"), "scene_token", F.col("__next").alias("following")), "closure")
        if level.isEmpty():
            break
        out = out.union(level.select("token", "ancestor", "depth"))
    return out


class Freeze:
    """Open-once protocol over files: artefacts are frozen by hash in a fixed order and cannot be frozen twice."""

    ORDER = ("prereg", "split", "selections")

    def __init__(self, folder: str):
        self.folder = folder

    def _path(self, what: str) -> str:
        return os.path.join(self.folder, f"{what}.frozen.json")

    def freeze(self, what: str, body: bytes) -> str:
        for earlier in self.ORDER[: self.ORDER.index(what)]:
            if not os.path.exists(self._path(earlier)):
                raise ContractError(f"{earlier} must be frozen before {what}")
        digest = hashlib.sha256(body).hexdigest()
        with open(self._path(what), "x") as f:
            json.dump({"what": what, "sha256": digest}, f)
        return digest

    def check(self, what: str, body: bytes) -> None:
        with open(self._path(what)) as f:
            if json.load(f)["sha256"] != hashlib.sha256(body).hexdigest():
                raise ContractError(f"{what} changed after it was frozen")

"""Read-side queries: pages, details, reviews, label-free analysis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import pipe_split, tag_matches
from ..operators.aggregates import edge_histogram, equal_histogram, tag_lift


def frame_page(frames: DataFrame, offset: int = 0, limit: int = 50, sort: str = "rank", tag: str | None = None, selected_only: bool = False) -> DataFrame:
    """A page by rank, or by falling score then rank; a tag keeps frames with that tag or one that starts with it."""
    df = frames.filter("selected") if selected_only else frames
    df = df.filter(tag_matches(pipe_split(F.col("pred_tags")), tag)) if tag else df
    order = [F.col("rank").asc_nulls_last()] if sort == "rank" else [F.col(sort).desc(), F.col("rank").asc_nulls_last()]
    return df.orderBy(*order, "sample_token").offset(offset).limit(limit)


def review_queue(context: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    return context.filter("review").orderBy("sample_token", "cam").offset(offset).limit(limit)


def frame_detail(token: str, tables: Mapping[str, DataFrame], per_camera: Sequence[str] = ("images", "boxes_2d"), per_frame: Sequence[str] = ("boxes_3d", "objects")) -> DataFrame:
    """One row: every table's rows of a token as an array of structs; filters go down into the scans."""
    out: DataFrame | None = None
    for name in (*per_camera, *per_frame):
        if name in tables:
            t = tables[name].where(F.col("sample_token") == token)
            own = t.agg(F.collect_list(F.struct(*[c for c in t.columns if c != "sample_token"])).alias(name))
            out = own if out is None else out.crossJoin(own)
    if out is None:
        raise ValueError("no tables")
    return out.withColumn("sample_token", F.lit(token))


def label_free(frames: DataFrame, objects: DataFrame) -> dict[str, DataFrame]:
    """Batch analysis without labels: tags with lift, reasons, classes, distances, scenes, score histogram."""
    base = frames.withColumn("tags", pipe_split(F.col("pred_tags")))
    best = objects.join(frames.filter("selected").select("sample_token"), "sample_token", "left_semi").withColumn("__n", F.row_number().over(Window.partitionBy("sample_token").orderBy(F.col("s_obj").desc(), "object_id"))).filter("__n = 1")
    return {
        "tags": tag_lift(base, "tags", "selected"),
        "reasons": best.groupBy(F.split("reasons", " ")[0].alias("reason")).agg(F.count(F.lit(1)).alias("n")),
        "classes": objects.groupBy("cls_pred").agg(F.count(F.lit(1)).alias("n")),
        "distances": edge_histogram(objects.filter("cls_pred <> 'other'"), "dist_m", [0, 10, 20, 30, 40, 50]),
        "scenes": frames.groupBy("scene_token").agg(F.count(F.lit(1)).alias("pool"), F.count_if("selected").alias("selected")),
        "scores": equal_histogram(frames.filter("gate = 'valid'"), "s_frame", 20),
    }


def duplicate_tags(frames: DataFrame, group: str = "group", rank: str = "rank") -> DataFrame:
    """For every ranked frame of a duplicate group but the first: the rank of the first."""
    w = Window.partitionBy(group)
    first = F.min(rank).over(w)
    return frames.withColumn("duplicate_of_rank", F.when((F.count(F.lit(1)).over(w) > 1) & (F.col(rank) > first), first))


def examples(ours: DataFrame, rival: DataFrame, struggle: DataFrame, most: int = 12) -> DataFrame:
    """Frames of our selection that the rival does not have, most struggling instances first."""
    own = ours.join(rival.select("sample_token"), "sample_token", "left_anti")
    index = struggle.filter("struggle").groupBy("sample_token").agg(F.count_distinct("instance_token").alias("n_struggle"))
    return own.join(index, "sample_token", "left").na.fill(0, ["n_struggle"]).orderBy(F.col("n_struggle").desc(), "sample_token").limit(most)


def export_index(frames: DataFrame, media: DataFrame, files: DataFrame, budget: int) -> DataFrame:
    """Rows of an export: the first ``budget`` ranks with their images, the missing ones, and their metadata as JSON.

    media: (sample_token, cam, img_path); files: (filename) that exist."""
    chosen = frames.filter(F.col("rank") <= budget)
    there = files.select(F.col("filename").alias("img_path"), F.lit(True).alias("there")).distinct()
    per = media.join(chosen.select("sample_token"), "sample_token", "left_semi").join(there, "img_path", "left").groupBy("sample_token").agg(
        F.array_sort(F.collect_list(F.when(F.col("there"), F.col("img_path")))).alias("images"), F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.col("img_path")))).alias("missing")
    )
    meta = F.to_json(F.struct(*[c for c in frames.columns]))
    return chosen.join(per, "sample_token", "left").select("sample_token", "rank", "images", F.array_join("missing", "|").alias("missing"), meta.alias("meta")).orderBy("rank")

"""Byte-range ledgers of uploads: what a resumable upload accepts, and what ranges are there and missing."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scans import ordered_scan

#: Most bytes of a chunk.
CHUNK = 50 << 20


def accepted(chunks: DataFrame, key: str, order: Sequence[str], start: str, length: str, most: int = CHUNK) -> DataFrame:
    """``chunks`` with ``status`` and ``size_after``: a chunk is appended only where its offset is what is there.

    accepted; duplicate (ends within what is there); conflict (starts elsewhere); too_large;
    invalid (no or a negative range).  The first status that fits holds, in the order
    invalid, too_large, accepted, duplicate, conflict; a null key is a key like any other."""
    out = T.StructType([*chunks.schema.fields, T.StructField("status", T.StringType()), T.StructField("size_after", T.LongType())])
    names = chunks.columns

    def step(state: list[int], row: dict[str, Any]) -> list[tuple]:
        offset, size, there = row[start], row[length], state[0]
        if offset is None or size is None or offset < 0 or size <= 0:
            status = "invalid"
        elif size > most:
            status = "too_large"
        elif offset == there:
            status, state[0] = "accepted", there + size
        else:
            status = "duplicate" if offset + size <= there else "conflict"
        return [(*(row[n] for n in names), status, state[0])]

    return ordered_scan(chunks, [key], order, lambda: [0], step, out)


def ranges(chunks: DataFrame, key: str, start: str, length: str) -> DataFrame:
    """key, start, stop: the chunks' ranges merged where they overlap or touch (gaps and islands); empty and negative ones count for nothing."""
    good = chunks.filter((F.col(start) >= 0) & (F.col(length) > 0)).select(key, F.col(start).cast("long").alias("start"), (F.col(start) + F.col(length)).cast("long").alias("stop"))
    by_place = Window.partitionBy(key).orderBy("start", "stop")
    reach = F.max("stop").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    numbered = good.withColumn("new", (F.col("start") > F.coalesce(reach, F.lit(-1))).cast("int"))
    islands = numbered.withColumn("island", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def missing(merged: DataFrame, totals: DataFrame, key: str, total: str) -> DataFrame:
    """key, start, stop: the holes of ``ranges`` up to each key's total; a key without chunks is one hole."""
    ends = totals.select(key, F.col(total).cast("long").alias("start"), F.col(total).cast("long").alias("stop"))
    whole = merged.join(totals.select(key, total), key).select(key, "start", "stop", total)
    cut = whole.filter(F.col("start") < F.col(total)).select(key, "start", F.least("stop", total).alias("stop")).unionByName(ends)
    before = F.coalesce(F.lag("stop").over(Window.partitionBy(key).orderBy("start", "stop")), F.lit(0).cast("long"))
    return cut.select(key, before.alias("begin"), F.col("start").alias("stop")).filter("begin < stop").withColumnRenamed("begin", "start")


def coverage(chunks: DataFrame, totals: DataFrame, key: str, start: str, length: str, total: str) -> DataFrame:
    """key, covered (bytes up to the total), parts, holes, resume_at (first missing byte), complete."""
    merged = ranges(chunks, key, start, length)
    capped = merged.join(totals.select(key, total), key).filter(F.col("start") < F.col(total)).groupBy(key).agg(F.sum(F.least("stop", total) - F.col("start")).alias("covered"), F.count(F.lit(1)).alias("parts"))
    holes = missing(merged, totals, key, total).groupBy(key).agg(F.count(F.lit(1)).alias("holes"), F.min("start").alias("first"))
    zero = F.lit(0).cast("long")
    met = totals.select(key, F.col(total).cast("long").alias("total")).join(capped, key, "left").join(holes, key, "left")
    return met.select(key, F.coalesce("covered", zero).alias("covered"), F.coalesce("parts", zero).alias("parts"), F.coalesce("holes", zero).alias("holes"), F.coalesce("first", "total").alias("resume_at"), (F.coalesce("holes", zero) == 0).alias("complete"))

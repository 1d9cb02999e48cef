"""The driver tables read as recordings: events are frames of a scene (user), lineitems are objects of a frame (order), embeddings are frame vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id (scene), event_type, value, t (microseconds), frame_idx."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("t"))
    return e.withColumn("frame_idx", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1)


FRAMES_SQL = """
f AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t,
         (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS frame_idx
  FROM events)
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label (scene), embedding."""
    return table(spark, sf_dir, "embeddings")


#: Columns that say which of several lineitems is the object, in this order; lineitems that a task sorts, about.
_FIRST = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
TASK_ROWS = 1_000_000


def objects(spark: SparkSession, sf_dir: str, need: Sequence[str] | None = None) -> DataFrame:
    """Lineitems as objects: one row for each (order, line number), the first by part and supplier.

    ``need`` names the columns besides the key that are read later: rows that agree in the order up to
    the last of them are equal then, so no later column is shuffled.  Rows are dealt by order once, which
    later joins and groups by order keep; with many rows there are more parts, not larger ones."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    order = _FIRST if need is None else _FIRST[: 1 + max(map(_FIRST.index, need))]
    parts = -(-l.count() // TASK_ROWS)
    if need is not None:
        l = l.select("l_orderkey", "l_linenumber", *order)  # noqa: E741
    many = parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    l = l.repartition(*([parts] if many else []), "l_orderkey")  # noqa: E741
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*order)
    return l.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


OBJECTS_SQL = """
o AS (
  SELECT * FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) = 1)
"""

"""Rank and score expressions over windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def bround6(x: Column) -> Column:
    """Six decimals, half to even: the rounding before every ordered selection."""
    return F.bround(x.cast("double"), 6)


def masked(x: Column, mask: Column | None) -> Column:
    return x if mask is None else F.when(mask, x)


def pct_rank(x: Column, mask: Column | None = None, by: Sequence[str | Column] = (), constant_is_zero: bool = True) -> Column:
    """Average rank over count among rows inside the mask, 0 outside; a constant signal is 0 unless told otherwise.

    Ties share their mean rank: rank plus half of the other tied rows.  Give ``by`` at
    scale: without it the ranking is global and one sort has to see all rows.
    """
    value = masked(x.cast("double"), mask)
    value = F.when(~F.isnan(value), value)
    inside = value.isNotNull()
    group = [F.lit(0)] if not by else list(by)
    own = Window.partitionBy(*group, inside)
    tied = Window.partitionBy(*group, inside, value)
    rank = F.rank().over(own.orderBy(value)) + (F.count(F.lit(1)).over(tied) - 1) / 2
    out = rank / F.count(F.lit(1)).over(own)
    if constant_is_zero:
        out = F.when(F.min(value).over(own) == F.max(value).over(own), F.lit(0.0)).otherwise(out)
    return F.when(inside, out).otherwise(F.lit(0.0))


def weighted(parts: Sequence[tuple[float, Column]]) -> Column:
    total = F.lit(0.0)
    for weight, part in parts:
        total = total + F.lit(float(weight)) * part
    return total


def robust_minmax(x: Column, low: Column, high: Column, mask: Column | None = None) -> Column:
    """Clipped position between two percentiles; 0 when they coincide or outside the mask."""
    place = F.when(high > low, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low)))).otherwise(F.lit(0.0))
    return place if mask is None else F.when(mask, place).otherwise(F.lit(0.0))


#: Distinct values up to which a global ranking is one sorted window over them; above it ranks are put together from value ranges.
SINGLE_WINDOW_ROWS = 2_000_000


def with_pct_rank(df: DataFrame, value: str, out: str, mask: str | None = None, constant_is_zero: bool = True, single_rows: int = SINGLE_WINDOW_ROWS, ranges: int = 256, rows: int | None = None) -> DataFrame:
    """``pct_rank`` over the whole table; only distinct values and their counts are ever sorted, never the rows.

    Values are counted (map-side combined), ranked and joined back.  More than
    ``single_rows`` of them are dealt into value ranges at approximate quantiles (``ranges``
    numbers on the driver), ranked inside their range and shifted by the totals of the
    ranges before (at most ``ranges`` rows, broadcast).  ``rows`` is an upper bound of the
    table's size where the caller has one, and saves the count of distinct values."""
    x = masked(F.col(value).cast("double"), F.col(mask) if mask else None)
    x = F.when(~F.isnan(x), x)
    counts = df.select(x.alias("__x")).filter("__x is not null").groupBy("__x").agg(F.count(F.lit(1)).alias("__c"))
    constant = F.col("__c") == F.col("__n")
    if (counts.count() if rows is None or rows > single_rows else rows) <= single_rows:
        upto = Window.partitionBy().orderBy("__x")
        ranks = counts.withColumns({"__upto": F.sum("__c").over(upto), "__n": F.sum("__c").over(Window.partitionBy())})
        rank = F.col("__upto") - (F.col("__c") - 1) / 2
    else:
        edges = sorted(set(counts.agg(F.percentile_approx("__x", F.array(*[F.lit((k + 1) / ranges) for k in range(ranges - 1)]), F.lit(10_000))).first()[0] or []))
        part = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col("__x"))) if edges else F.lit(0)
        dealt = counts.withColumn("__p", part)
        totals = dealt.groupBy("__p").agg(F.sum("__c").alias("__t"))
        upto = Window.partitionBy().orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select("__p", F.coalesce(F.sum("__t").over(upto), F.lit(0)).alias("__before"), F.sum("__t").over(Window.partitionBy()).alias("__n"))
        inner = Window.partitionBy("__p").orderBy("__x")
        ranks = dealt.join(F.broadcast(before), "__p").withColumn("__upto", F.sum("__c").over(inner))
        rank = F.col("__before") + F.col("__upto") - (F.col("__c") - 1) / 2
    scored = ranks.select("__x", F.when(constant & F.lit(constant_is_zero), F.lit(0.0)).otherwise(rank / F.col("__n")).alias(out))
    return df.withColumn("__x", x).join(scored, "__x", "left").drop("__x").withColumn(out, F.coalesce(out, F.lit(0.0)))


#: Rows of a sorted range that one task ranks.
RANGE_ROWS = 500_000


def _ranges(df: DataFrame, order: Sequence[Column], rows: int) -> DataFrame:
    """The rows dealt into sorted ranges of about ``rows``, each with its number ``__p``; stored, so that a range stays what it is."""
    parts = 1 + df.count() // rows
    return written(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()), "ranges")


def with_row_number(df: DataFrame, order: Sequence[Column], out: str, rows: int = RANGE_ROWS) -> DataFrame:
    """The number of each row in the order of the whole table, from 1: numbers within sorted ranges, shifted by the rows of the ranges before."""
    dealt = _ranges(df, order, rows)
    totals = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__t"))  # one row a range
    before = totals.select("__p", F.coalesce(F.sum("__t").over(Window.partitionBy().orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return dealt.withColumn(out, own).join(F.broadcast(before), "__p").withColumn(out, F.col("__before") + F.col(out)).drop("__p", "__before")


def with_group_pct_rank(df: DataFrame, value: str, by: Sequence[str], out: str, constant_is_zero: bool = True, rows: int = RANGE_ROWS) -> DataFrame:
    """``pct_rank`` within groups of any size: distinct values are counted, ranked in sorted ranges and joined back; no task sorts a group."""
    x = F.col(value).cast("double")
    x = F.when(~F.isnan(x), x)
    keys = [f"__g{i}" for i in range(len(by))]
    counts = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], x.alias("__y")).filter("__y is not null").groupBy(*keys, "__y").agg(F.count(F.lit(1)).alias("__c"))
    dealt = _ranges(written(counts, "value-counts"), [F.col(k) for k in (*keys, "__y")], rows)
    group = Window.partitionBy(*keys)
    totals = dealt.groupBy(*keys, "__p").agg(F.sum("__c").alias("__t"))  # one row a range and group
    before = totals.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("__p").alias("__q"), F.coalesce(F.sum("__t").over(group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__t").over(group).alias("__n"))
    same = F.col("__p") == F.col("__q")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    upto = F.sum("__c").over(Window.partitionBy(*keys, "__p").orderBy("__y"))
    rank = F.col("__before") + F.col("__upto") - (F.col("__c") - 1) / 2
    ranked = dealt.withColumn("__upto", upto).join(before, same).select(*keys, "__y", F.when((F.col("__c") == F.col("__n")) & F.lit(constant_is_zero), F.lit(0.0)).otherwise(rank / F.col("__n")).alias(out))
    there = F.col("__x") == F.col("__y")
    for c, k in zip(by, keys, strict=True):
        there &= F.col(c).eqNullSafe(F.col(k))
    rows_ = df.withColumn("__x", x)
    met = rows_.filter("__x is not null").join(ranked, there).drop("__x", "__y", *keys)
    return met.unionByName(rows_.filter("__x is null").drop("__x").withColumn(out, F.lit(0.0)))

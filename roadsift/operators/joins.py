"""Joins: checked equi-joins, time joins, spatial joins, chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ContractError, duplicate_keys
from ..scratch import written


def require_unique(df: DataFrame, key: Sequence[str], what: str = "table") -> DataFrame:
    if not duplicate_keys(df, tuple(key)).isEmpty():
        raise ContractError(f"{what}: duplicate keys on {', '.join(key)}")
    return df


def require_none(df: DataFrame, message: str) -> None:
    rows = df.take(5)
    if rows:
        raise ContractError(f"{message}: {[tuple(r) for r in rows]}")


def one_to_one(left: DataFrame, right: DataFrame, key: Sequence[str], complete: bool = False) -> DataFrame:
    """Left join with unique keys on both sides; with ``complete`` every left row must have a partner and the other way round."""
    require_unique(left, key, "left")
    return many_to_one(left, right, key, complete)


def many_to_one(left: DataFrame, right: DataFrame, key: Sequence[str], complete: bool = False) -> DataFrame:
    require_unique(right, key, "right")
    if complete:
        require_none(left.select(*key).join(right.select(*key), list(key), "left_anti"), "no partner for")
        require_none(right.select(*key).join(left.select(*key), list(key), "left_anti"), "unknown key")
    return left.join(right, list(key), "left")


def left_with_zero(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Left join; numeric columns of the right side are 0 where there is no partner."""
    added = [c for c in right.columns if c not in key]
    return left.join(right, list(key), "left").na.fill(0, subset=added)


def only(df: DataFrame, tokens: DataFrame, key: str = "sample_token") -> DataFrame:
    return df.join(tokens.select(key).distinct(), key, "left_semi")


def without(df: DataFrame, tokens: DataFrame, key: str = "sample_token") -> DataFrame:
    return df.join(tokens.select(key).distinct(), key, "left_anti")


def require_subset(df: DataFrame, allowed: DataFrame, key: str = "sample_token", message: str = "tokens outside the pool") -> DataFrame:
    require_none(without(df.select(key), allowed, key), message)
    return df


def previous_value(value: Column, scene: Sequence[str], index: str) -> Column:
    """The value one frame earlier: only a row whose index is exactly one less counts."""
    w = Window.partitionBy(*scene).orderBy(index)
    return F.when(F.col(index) - F.lag(index).over(w) == 1, F.lag(value).over(w))


def asof_nearest(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, tolerance: float) -> DataFrame:
    """Each left row with the right row nearest in time within the tolerance; ties go to the earlier time.

    Both sides are cut into buckets of the tolerance, the right side into three, so this is
    an equi-join on ``by`` and the bucket, not a range join."""
    bucket = lambda c: F.floor(c / F.lit(tolerance)).cast("long")
    l = left.withColumn("__b", bucket(F.col(left_time))).withColumn("__l", F.monotonically_increasing_id())  # noqa: E741
    extra = [c for c in right.columns if c not in by]
    r = right.select(*by, F.struct(*extra).alias("__r"), F.explode(F.array(*[bucket(F.col(right_time)) + d for d in (-1, 0, 1)])).alias("__b"))
    gap = F.abs(F.col(left_time) - F.col(f"__r.{right_time}"))
    met = l.join(r, [*by, "__b"], "left").withColumn("__gap", gap)
    w = Window.partitionBy("__l").orderBy(F.col("__gap").asc_nulls_last(), F.col(f"__r.{right_time}"))
    best = met.withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    ok = F.col("__gap") <= tolerance
    return best.select(*left.columns, *[F.when(ok, F.col(f"__r.{c}")).alias(c if c not in left.columns else f"{c}_right") for c in extra])


def asof_last(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, value: str, out: str) -> DataFrame:
    """Each left row with the latest right value at or before its time: one sort of the union, no range join."""
    l = left.withColumns({"__t": F.col(left_time), "__side": F.lit(1), "__v": F.lit(None).cast(right.schema[value].dataType)})  # noqa: E741
    r = right.select(*by, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(out, F.last("__v", ignorenulls=True).over(w)).filter("__side = 1").drop("__t", "__side", "__v")


def interpolate_pose(times: DataFrame, poses: DataFrame, by: Sequence[str], time: str = "t", columns: Sequence[str] = ("x", "y"), angle: str | None = "yaw") -> DataFrame:
    """Linear interpolation of poses at given times; the angle goes the short way round; outside the track the nearest pose holds."""
    names = [*columns, *([angle] if angle else [])]
    p = poses.select(*by, F.col(time), F.struct(F.col(time).alias("t"), *names).alias("__p"))
    both = times.withColumn("__want", F.lit(True)).unionByName(p, allowMissingColumns=True)
    base = Window.partitionBy(*by).orderBy(time, F.col("__p").isNull())
    before = F.last("__p", ignorenulls=True).over(base.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    back = Window.partitionBy(*by).orderBy(F.col(time).desc(), F.col("__p").isNull())  # backwards: a running frame, not a quadratic one
    after = F.last("__p", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = both.withColumns({"__a": before, "__z": after}).filter("__want").withColumns({"__a": F.coalesce("__a", "__z"), "__z": F.coalesce("__z", "__a")})
    share = F.coalesce(F.try_divide(F.col(time) - F.col("__a.t"), F.col("__z.t") - F.col("__a.t")), F.lit(0.0))
    out = {c: F.col(f"__a.{c}") + share * (F.col(f"__z.{c}") - F.col(f"__a.{c}")) for c in columns}
    if angle:
        turn = F.pmod(F.col(f"__z.{angle}") - F.col(f"__a.{angle}") + F.lit(3.141592653589793), F.lit(6.283185307179586)) - F.lit(3.141592653589793)
        out[angle] = F.col(f"__a.{angle}") + share * turn
    return met.select(*times.columns, *[v.alias(k) for k, v in out.items()])


def within_radius(points: DataFrame, centres: DataFrame, by: Sequence[str], radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """Rows of ``centres`` that have a point within the closed radius in the same group (frame); a cell grid keeps the join equi."""
    cell = lambda c: F.floor(F.col(c) / F.lit(radius)).cast("long")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    p = points.select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"), cell(x).alias("__cx"), cell(y).alias("__cy"))
    c = centres.withColumn("__c", F.monotonically_increasing_id()).withColumn("__a", F.explode(around)).withColumns({"__cx": cell(x) + F.col("__a.i"), "__cy": cell(y) + F.col("__a.j")})
    met = c.join(p, [*by, "__cx", "__cy"])
    dx, dy = F.col(x) - F.col("__x"), F.col(y) - F.col("__y")
    return met.filter(dx * dx + dy * dy <= radius * radius).select(*centres.columns, "__c").dropDuplicates(["__c"]).drop("__c")


def adjacent_speed(df: DataFrame, instance: str = "instance_token", time: str = "timestamp", x: str = "x", y: str = "y") -> Column:
    """Central difference speed along an instance's track (time in microseconds), one-sided at its ends, null for one box."""
    w = Window.partitionBy(instance).orderBy(time)
    side = lambda c, f: F.coalesce(f(c).over(w), F.col(c))
    dt = (side(time, F.lead) - side(time, F.lag)) / F.lit(1_000_000.0)
    dx, dy = side(x, F.lead) - side(x, F.lag), side(y, F.lead) - side(y, F.lag)
    return F.when(dt > 0, F.sqrt(dx * dx + dy * dy) / dt)


def chain_walk(spark, nodes: DataFrame, starts: DataFrame, token: str, following: str, start: str) -> DataFrame:  # type: ignore[no-untyped-def]
    """Follows ``following`` from every start: (first, token, position from 0); a null or empty ``following`` ends a chain.

    Pointer doubling: a jump table leads 2^k nodes ahead, and a round takes all walks of up
    to 2^k nodes twice as far, so a chain of n nodes takes log2(n) joins of the jump table
    with itself and with the walks.  A chain longer than the table has nodes is a cycle."""
    ahead = F.col(following).cast("string")
    jump = written(nodes.select(F.col(token).alias("token"), F.when(ahead != "", F.col(following)).alias("to")).filter("to is not null"), "jumps")
    walk = starts.select(F.col(start).alias("first")).distinct().select("first", F.col("first").alias("token"), F.lit(0).cast("long").alias("position"))
    n, step = jump.count(), 1
    while n:
        far = written(walk.join(jump.hint("merge"), "token").select("first", F.col("to").alias("token"), (F.col("position") + step).alias("position")), "walks")
        if far.isEmpty():
            break
        if step > n:
            raise ValueError("the chain has a cycle")
        walk = walk.unionByName(far)
        onward = jump.select(F.col("token").alias("to"), F.col("to").alias("next")).hint("merge")
        jump = written(jump.join(onward, "to").select("token", F.col("next").alias("to")), "jumps")
        step *= 2
    return walk.select("first", "token", F.col("position").cast("int").alias("position"))


def by_time_position(df: DataFrame, scene: Sequence[str], order: Sequence[str], out: str = "frame_idx") -> DataFrame:
    """0-based position in the scene; the cheap form of a chain walk when times strictly increase."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*scene).orderBy(*order)) - 1)

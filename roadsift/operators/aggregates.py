"""Grouped aggregates, quantiles, histograms, frequencies and windows over groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import binary_entropy, equal_width_bin
from ..scratch import written
from .curves import with_running


def quantile_linear(x: str | Column, q: float) -> Column:
    """Exact percentile with linear interpolation."""
    return F.percentile(x, F.lit(q))


#: Rows up to which exact percentiles come from one aggregate, which holds a count for every distinct value.
SINGLE_PERCENTILE_ROWS = 5_000_000


def exact_percentiles(df: DataFrame, column: str, qs: Sequence[float], single_rows: int = SINGLE_PERCENTILE_ROWS, margin: float = 0.001) -> list[float | None]:
    """Exact linear percentiles of a whole column, of any size.

    Large columns: approximate quantiles a little below and above bracket each percentile,
    one pass counts what lies below the bracket and a second takes the exact order
    statistics of the bracket alone (about 2 * margin of the rows)."""
    x = F.col(column).cast("double")
    rows = df.select(x.alias("x")).filter(x.isNotNull() & ~F.isnan(x))
    n = rows.count()
    if not n:
        return [None for _ in qs]
    if n <= single_rows:
        return list(rows.agg(F.percentile("x", F.array(*[F.lit(float(q)) for q in qs]))).first()[0])
    around = [max(0.0, q - margin) for q in qs] + [min(1.0, q + margin) for q in qs]
    ends = rows.agg(F.percentile_approx("x", F.array(*[F.lit(a) for a in around]), F.lit(int(10 / margin))), F.min("x"), F.max("x")).first()
    low = [ends[1] if a == 0 else v for a, v in zip(around[: len(qs)], ends[0], strict=False)]
    high = [ends[2] if a == 1 else v for a, v in zip(around[len(qs) :], ends[0][len(qs) :], strict=True)]
    counts = rows.agg(*[F.count_if(F.col("x") < v) for v in low], *[F.count_if(F.col("x").between(a, b)) for a, b in zip(low, high, strict=True)]).first()
    out: list[float | None] = []
    for k, q in enumerate(qs):
        place, below, inside = (n - 1) * q, counts[k], counts[len(qs) + k]
        if not below <= place <= below + inside - 1:
            return list(rows.agg(F.percentile("x", F.array(*[F.lit(float(p)) for p in qs]))).first()[0])
        share = (place - below) / (inside - 1) if inside > 1 else 0.0
        out.append(rows.filter(F.col("x").between(low[k], high[k])).agg(F.percentile("x", F.lit(share))).first()[0])
    return out


def quantile_higher(x: Column, q: float) -> Column:
    """The element at ceil((n - 1) q) of the sorted values; an aggregate for groups of bounded size."""
    values = F.sort_array(F.collect_list(x))
    return F.try_element_at(values, (F.ceil((F.size(values) - 1) * F.lit(q)) + 1).cast("int"))


def quantile_higher_ranked(df: DataFrame, by: Sequence[str], value: str, q: float, out: str = "quantile") -> DataFrame:
    """The same by ranks and counts instead of collected values: for groups of any size."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*by)
    place = counts.withColumns({"__upto": F.sum("__c").over(w.orderBy(value)), "__n": F.sum("__c").over(w)})
    return place.filter(F.col("__upto") >= F.ceil((F.col("__n") - 1) * F.lit(q)) + 1).groupBy(*by).agg(F.min(value).alias(out))


def quantiles_higher(df: DataFrame, by: Sequence[str], values: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """``by``, name, q0, q1, ...: the same for several values and several quantiles, from one count of distinct values and one window."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("x")) for v in values])).alias("p")
    counts = df.select(*by, pairs).select(*by, "p.name", "p.x").filter("x is not null").groupBy(*by, "name", "x").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by, "name")
    place = counts.withColumns({"upto": F.sum("c").over(w.orderBy("x")), "n": F.sum("c").over(w)})
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil((F.col("n") - 1) * F.lit(q)) + 1, F.col("x")))
    return place.groupBy(*by, "name").agg(*[at(q).alias(f"q{k}") for k, q in enumerate(qs)])


def quantiles_linear(df: DataFrame, by: str, value: str, qs: Mapping[str, float]) -> DataFrame:
    """``by`` and the linearly interpolated quantiles by name; null for a group without values.

    Distinct values and their counts are sorted in ranges of bounded size, whatever the sizes of the groups."""
    x = F.col(value).cast("double")
    counts = written(df.select(F.col(by).alias("__g"), x.alias("__x")).groupBy("__g", "__x").agg(F.count("__x").alias("__c")), "value-counts")
    upto = with_running(counts, [F.col("__g").asc(), F.col("__x").asc()], {"__upto": F.col("__c")})
    ranked = written(upto.select("__g", "__x", "__c", "__upto"), "value-ranks")
    groups = ranked.groupBy(F.col("__g").alias("__h")).agg(F.min(F.col("__upto") - F.col("__c")).alias("__before"), F.sum("__c").alias("__n"))
    met = ranked.join(F.broadcast(groups), F.col("__g").eqNullSafe(F.col("__h"))).select("__g", "__x", "__n", (F.col("__upto") - F.col("__before")).alias("__upto")).filter("__x is not null or __n = 0")
    place = {c: (F.col("__n") - 1) * F.lit(float(q)) for c, q in qs.items()}
    at = lambda k: F.min(F.when(F.col("__upto") > k, F.col("__x")))
    ends = met.groupBy("__g").agg(F.max("__n").alias("__n"), *[at(g(p)).alias(f"{c}_{n}") for c, p in place.items() for n, g in (("low", F.floor), ("high", F.ceil))])
    low, high = (lambda c: F.col(f"{c}_low")), (lambda c: F.col(f"{c}_high"))
    between = lambda c, p: F.when(low(c) == high(c), low(c)).otherwise((F.ceil(p) - p) * low(c) + (p - F.floor(p)) * high(c))
    return ends.select(F.col("__g").alias(by), *[between(c, p).alias(c) for c, p in place.items()])


def discrete_percentile(df: DataFrame, by: Sequence[str], value: str, q: float, out: str = "percentile") -> DataFrame:
    """Smallest value whose cumulative share reaches q."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*by)
    share = F.sum("__c").over(w.orderBy(value)) / F.sum("__c").over(w)
    return counts.withColumn("__s", share).filter(F.col("__s") >= q).groupBy(*by).agg(F.min(value).alias(out))


def detections_per_image(dets: DataFrame, key: Sequence[str], conf: str = "conf", confident: float = 0.5) -> DataFrame:
    """Count, mean binary entropy in bits, and count of confident detections."""
    return dets.groupBy(*key).agg(F.count(F.lit(1)).alias("det_n"), F.avg(binary_entropy(F.col(conf))).alias("det_ent"), F.count_if(F.col(conf) >= confident).alias("det_n_conf"))


def equal_histogram(df: DataFrame, value: str, bins: int = 20, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """bin (1-based) and n, empty bins included; the last bin is closed."""
    counts = df.select(equal_width_bin(F.col(value), bins, low, high).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    all_bins = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def edge_histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Counts in [e0, e1), [e1, e2), ..., [last, infinity) in one row; nulls are left out."""
    bounds = [*edges, float("inf")]
    return df.agg(*[F.count_if((F.col(value) >= a) & (F.col(value) < b)).alias(f"bin{k}") for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))])


def normalised_histogram(df: DataFrame, by: Sequence[str], value: str, edges: Sequence[float], out: str = "hist") -> DataFrame:
    """Shares per bin as an array, values clipped to the outer edges."""
    x = F.least(F.greatest(F.col(value), F.lit(float(edges[0]))), F.lit(float(edges[-1])))
    last = len(edges) - 2
    counts = [F.count_if((x >= a) & ((x < b) if k < last else (x <= b))) / F.greatest(F.count(value), F.lit(1)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return df.groupBy(*by).agg(F.array(*counts).alias(out))


def grid_counts(df: DataFrame, by: Sequence[str], x: str, y: str, cell: float, half: float) -> DataFrame:
    """Point counts and log1p of a square grid around the origin; indexes are clipped into the grid."""
    n = int(round(2 * half / cell))
    index = lambda c: F.least(F.greatest(F.floor((F.col(c) + half) / cell), F.lit(0)), F.lit(n - 1)).cast("int")
    return df.groupBy(*by, index(y).alias("iy"), index(x).alias("ix")).agg(F.count(F.lit(1)).alias("n")).withColumn("log_n", F.log1p("n"))


def majority(df: DataFrame, by: Sequence[str], value: str, out: str = "mode") -> DataFrame:
    """Most frequent value, the smallest on ties, only if more than half of all rows of the group have it."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    best = counts.groupBy(*by).agg(F.sum("__c").alias("__n"), F.max(F.when(F.col(value).isNotNull(), F.col("__c"))).alias("__top"))
    winner = counts.filter(F.col(value).isNotNull()).join(best, list(by)).filter("__c = __top and 2 * __c > __n").groupBy(*by).agg(F.min(value).alias(out))
    return best.select(*by).join(winner, list(by), "left")


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first in a total order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def frame_frequency(df: DataFrame, frame: str, cell: str, by: Sequence[str] = (), frames: DataFrame | None = None) -> DataFrame:
    """Share of frames that hold a cell, counted once a frame, within each group (split)."""
    base = (frames if frames is not None else df).select(*by, frame).distinct()
    total = base.groupBy(*by).agg(F.count(F.lit(1)).alias("n_frames")) if by else base.agg(F.count(F.lit(1)).alias("n_frames"))
    counts = df.select(*by, frame, cell).distinct().groupBy(*by, cell).agg(F.count(F.lit(1)).alias("n"))
    met = counts.join(total, list(by)) if by else counts.crossJoin(F.broadcast(total))
    return met.withColumn("freq", F.col("n") / F.col("n_frames"))


def class_prior(df: DataFrame, kind: str, instance: str | None = None) -> DataFrame:
    """Share of objects (or of distinct instances) of each class."""
    count = F.count(F.lit(1)) if instance is None else F.count_distinct(instance)
    counts = df.groupBy(kind).agg(count.alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))


def conditional_frequency(df: DataFrame, context: str, event: str, instance: str) -> DataFrame:
    """Instances that show an event in a context over all instances in the context."""
    base = df.groupBy(context).agg(F.count_distinct(instance).alias("n_context"))
    own = df.filter(F.col(event).isNotNull()).groupBy(context, event).agg(F.count_distinct(instance).alias("n"))
    return own.join(base, context).withColumn("p", F.col("n") / F.col("n_context"))


def gated_or(df: DataFrame, flags: Sequence[str], most: float, out: str = "is_rare", by: Sequence[str] = ()) -> DataFrame:
    """OR of the flags whose frequency in the pool is at most ``most``."""
    w = Window.partitionBy(*by)
    cond = F.lit(False)
    for f in flags:
        cond = cond | (F.col(f) & (F.avg(F.col(f).cast("double")).over(w) <= most))
    return df.withColumn(out, cond)


def threshold_grid(df: DataFrame, by: Sequence[str], frame: str, freq: str, taus: Sequence[float]) -> DataFrame:
    """For every tau: frames with any cell rarer than tau, and their share."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("tau")
    rare = df.select(*by, frame, freq, grid).groupBy(*by, "tau").agg(F.count_distinct(F.when(F.col(freq) < F.col("tau"), F.col(frame))).alias("n_rare"), F.count_distinct(frame).alias("n_frames"))
    return rare.withColumn("share", F.col("n_rare") / F.col("n_frames"))


def base_rates(df: DataFrame, axes: Sequence[str], scene: str) -> DataFrame:
    """Hits, rate and distinct scenes of each boolean axis."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("hit")) for a in axes]))
    long = df.select(scene, pairs.alias("p")).select(scene, "p.axis", "p.hit")
    return long.groupBy("axis").agg(F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("double")).alias("rate"), F.count_distinct(F.when(F.col("hit"), F.col(scene))).alias("scenes"))


def tag_lift(df: DataFrame, tags: str, selected: str) -> DataFrame:
    """Rate of each tag in the pool and in the selection, and the lift."""
    sizes = df.agg(F.count(F.lit(1)).alias("n_pool"), F.count_if(selected).alias("n_sel"))
    each = df.select(selected, F.explode(F.array_distinct(tags)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("pool"), F.count_if(selected).alias("sel")).crossJoin(F.broadcast(sizes))
    rates = each.withColumns({"base": F.col("pool") / F.col("n_pool"), "share": F.coalesce(F.try_divide("sel", "n_sel"), F.lit(0.0))})
    return rates.withColumn("lift", F.try_divide("share", "base")).select("tag", "pool", "sel", "base", "share", "lift")


def mean_std(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and population deviation over repeated runs."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def class_stats(df: DataFrame, kind: str, sides: Sequence[str], least: float = 0.05) -> DataFrame:
    """Median and population deviation (at least ``least``) of box sides by class."""
    return df.groupBy(kind).agg(*[a for s in sides for a in (F.median(s).alias(f"{s}_median"), F.greatest(F.stddev_pop(s), F.lit(least)).alias(f"{s}_std"))])


def zero_filled_counts(df: DataFrame, kind: str, classes: Sequence[str]) -> DataFrame:
    """Counts of all classes in a list, 0 where there is none."""
    listed = df.sparkSession.createDataFrame([(c,) for c in classes], f"{kind} string")
    return listed.join(df.groupBy(kind).agg(F.count(F.lit(1)).alias("n")), kind, "left").select(kind, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def spaced_count(df: DataFrame, scene: str, index: str, gap: int, out: str = "n") -> DataFrame:
    """Most frames of a scene that keep an index distance of ``gap``, counted greedily from the smallest."""
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.col(index).cast("long"))), F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("n")),
        lambda s, x: F.when(s["last"].isNull() | (x - s["last"] >= gap), F.struct(x.alias("last"), (s["n"] + 1).alias("n"))).otherwise(s), lambda s: s["n"],
    )
    return df.groupBy(scene).agg(fold.alias(out))


def has_close_neighbour(time: str, scene: Sequence[str], gap: float) -> Column:
    """Whether the row before or after in the scene is within the gap."""
    w = Window.partitionBy(*scene).orderBy(time)
    return F.coalesce(F.col(time) - F.lag(time).over(w) <= gap, F.lit(False)) | F.coalesce(F.lead(time).over(w) - F.col(time) <= gap, F.lit(False))


def dataset_summary(frames: DataFrame, annotations: DataFrame | None = None, lidar: DataFrame | None = None) -> DataFrame:
    """Scenes, frames, images per camera as a map, and whether annotations and point clouds exist."""
    counts = frames.groupBy("cam").agg(F.count(F.lit(1)).alias("n"))
    per_camera = counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cam", "n")))).alias("images"))
    base = frames.agg(F.count_distinct("scene_token").alias("scenes"), F.count_distinct("sample_token").alias("frames"), F.count(F.lit(1)).alias("n_images"))
    has = lambda d: F.lit(d is not None and not d.isEmpty())
    return base.crossJoin(per_camera).select("scenes", "frames", "images", (F.col("n_images") > 0).alias("ok"), has(annotations).alias("has_annotations"), has(lidar).alias("has_lidar"))


def pivot_report(df: DataFrame, row: str, metric: str, mean: str = "mean", std: str = "std", metrics: Sequence[str] | None = None) -> DataFrame:
    """Runs by metrics, each cell "mean ± std"."""
    cell = F.concat(F.format_string("%.3f", mean), F.when(F.col(std) > 0, F.format_string(" ± %.3f", std)).otherwise(F.lit("")))
    return df.withColumn("__cell", cell).groupBy(row).pivot(metric, list(metrics) if metrics else None).agg(F.first("__cell"))


def map_lookup(df: DataFrame, key: str, table: Mapping[str, object], out: str) -> DataFrame:
    """A small literal map as a column; unknown keys give null."""
    return df.withColumn(out, F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(key)] if table else F.lit(None))

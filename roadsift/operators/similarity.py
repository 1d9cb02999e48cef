"""Vector operators: exact cross-scene neighbours in blocks, similarity joins, duplicate groups, embeddings.

Up to ``BROADCAST_BYTES`` of candidate vectors (a checked size) the matrix is broadcast
and each Arrow batch is one matrix product.  Beyond it a pivot index (``pivots.py``) cuts
queries and candidates into blocks of near rows.  A few near blocks give every query a
bound on its k-th distance; then only block pairs that triangle bounds cannot rule out are
compared.  Similarity joins skip block pairs by the same bounds, and equal vectors are one
row there, so a crowd of copies makes no pairs among itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import FLOOR
from ..scratch import written
from .pivots import Block, PivotIndex, Summaries

BROADCAST_BYTES = 64 << 20
#: Near blocks that give a query block its first bounds.
SEEDS = 3
#: Distances that a task holds at a time (a query's row of them at least).
CELLS = 1 << 20
#: Edges up to which one task ends the search for connected groups.
TAIL = 20_000


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def _tiles(n: int, width: int) -> Iterator[slice]:
    """Cuts ``n`` rows so that a matrix of a part by ``width`` columns has at most CELLS numbers."""
    step = max(1, CELLS // max(1, width))
    return (slice(at, at + step) for at in range(0, n, step))


def _codes(values: pa.Array, known: pa.Array) -> np.ndarray:
    """Places of values among known ones, a missing value as one of its own; -1 where there is none."""
    return pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy(zero_copy_only=False)


def _distances(metric: str, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    if metric == "cosine":
        return 1.0 - q @ c.T
    square = (q * q).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (q @ c.T)
    return np.sqrt(np.maximum(square, 0.0))


def _smallest(values: np.ndarray, k: int) -> list[list[float]]:
    """Up to k smallest finite values of each row."""
    k = min(k, values.shape[1])
    part = np.partition(values, k - 1, axis=1)[:, :k] if k and k < values.shape[1] else values
    part = np.sort(part, axis=1)
    return [row[np.isfinite(row)].tolist() for row in part]


def knn_distances(
    queries: DataFrame, candidates: DataFrame, key: str, vector: str, k: int, metric: str = "cosine", scene: str | None = None, index: str | None = None, min_gap: int = 0,
    broadcast_bytes: int = BROADCAST_BYTES, block_rows: int | None = None, report: dict[str, int] | None = None,
) -> DataFrame:
    """``key`` and ``near``: the k smallest distances of each query, ascending.

    With ``scene`` candidates of the query's scene are left out; with ``index`` instead,
    candidates of the scene nearer than ``min_gap`` frames are.  ``report`` receives the
    number of block pairs and of those compared where the pivot index is used."""
    spark = queries.sparkSession
    extra = [c for c in (scene, index) if c]
    q = queries.select(F.col(key), F.col(vector).cast("array<double>").alias("__v"), *[F.col(c).cast("string" if c == scene else "long").alias(f"__{i}") for i, c in enumerate(extra)])
    c = candidates.select(F.col(vector).cast("array<double>").alias("__v"), *[F.col(x).cast("string" if x == scene else "long").alias(f"__{i}") for i, x in enumerate(extra)])
    facts = c.agg(F.count(F.lit(1)), F.max(F.size("__v"))).first()
    n, width = facts[0], facts[1] or 0

    def near(qs: pd.DataFrame, cm: np.ndarray, scenes: pa.Array | None, cx: list[np.ndarray]) -> list[list[float]]:
        out: list[list[float]] = []
        own = _codes(pa.array(qs["__0"], pa.string()), scenes) if scene else None
        place = qs["__1"].to_numpy(np.int64) if index else None
        for at in _tiles(len(qs), len(cm)):
            d = _distances(metric, _matrix(qs["__v"].iloc[at]), cm)
            if scene:
                same = own[at, None] == cx[0][None]
                if index:
                    same &= np.abs(place[at, None] - cx[1][None]) < min_gap
                d[same] = np.inf
            out += _smallest(d, k)
        return out

    schema = T.StructType([T.StructField(key, queries.schema[key].dataType), T.StructField("near", T.ArrayType(T.DoubleType()))])
    if n * width * 8 <= broadcast_bytes:
        rows = c.toPandas()
        names = pa.array(rows["__0"], pa.string()) if scene else None
        scenes = names.unique() if scene else None
        held = spark.sparkContext.broadcast((_matrix(rows["__v"]), scenes, [_codes(names, scenes) if x == scene else rows[f"__{i}"].to_numpy(np.int64) for i, x in enumerate(extra)]))

        def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cm, scenes, cx = held.value
            for b in batches:
                yield pd.DataFrame({key: b[key], "near": near(b, cm, scenes, cx) if len(cm) else [[]] * len(b)})

        return q.mapInPandas(one, schema)
    return _knn_by_pivots(q, c, key, schema, k, metric, bool(scene), bool(index), min_gap, block_rows, report)


def _knn_by_pivots(q: DataFrame, c: DataFrame, key: str, schema: T.StructType, k: int, metric: str, by_scene: bool, by_index: bool, min_gap: int, block_rows: int | None, report: dict[str, int] | None) -> DataFrame:
    """The k smallest distances by a pivot index: seeds, a bound a query, then the block pairs within it."""
    extra = [f"__{i}" for i in range(by_scene + by_index)]
    there = PivotIndex.build(c, "__v", extra, block_rows=block_rows)
    here = PivotIndex.build(q, "__v", [key, *extra], there.pivots, block_rows)
    if not there.count:
        return q.select(key, F.array().cast("array<double>").alias("near"))

    def nearest(a: Summaries, b: Summaries, gap: np.ndarray) -> np.ndarray:
        middle = np.zeros_like(gap)
        for p in range(a.low.shape[1]):
            middle = np.maximum(middle, np.abs((a.low[:, p] + a.high[:, p])[:, None] - (b.low[:, p] + b.high[:, p])[None]) / 2)
        out = np.zeros(gap.shape, bool)
        out[np.arange(len(gap))[:, None], np.argsort(middle, axis=1, kind="stable")[:, :SEEDS]] = True
        return out

    def within(a: Summaries, b: Summaries, gap: np.ndarray) -> np.ndarray:
        """a.norm holds the largest k-th distance so far of the block's queries."""
        if metric == "cosine":  # |q| is no longer at hand: a block's own norm stands beside the bound
            return 1.0 - (own_norm + b.norm[None] - gap * gap) / 2 <= a.norm[:, None] + 1e-9
        return gap <= a.norm[:, None]

    own_norm = float(here.blocks.agg(F.coalesce(F.max("norm"), F.lit(0.0))).first()[0])

    def compare(one: Block, partners: Iterator[Block]) -> Iterator[pa.Table]:
        """The k smallest distances of each row of a block over all its partners here."""
        keys, n = one.keys, len(one.vectors)
        bound = np.frombuffer(one.more.as_buffer(), np.float64) if one.more is not None and one.more.is_valid else np.full(n, np.inf)
        best = np.full((n, k), np.inf)
        for other in partners:
            others = other.keys
            if by_scene:
                scenes = others.column("__0").combine_chunks().unique()
                own, there = (_codes(x.column("__0").combine_chunks(), scenes) for x in (keys, others))
            if by_index:
                place, places = (x.column("__1").to_numpy() for x in (keys, others))
            for at in _tiles(n, len(other.vectors)):
                d = _distances(metric, one.vectors[at], other.vectors)
                if by_scene:
                    same = own[at, None] == there[None]
                    if by_index:
                        same &= np.abs(place[at, None] - places[None]) < min_gap
                    d[same] = np.inf
                d[d > bound[at, None]] = np.inf
                best[at] = np.sort(np.concatenate([best[at], np.partition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else d], axis=1), axis=1)[:, :k]
        full = np.flatnonzero(np.isfinite(best[:, 0]))
        near = [row[np.isfinite(row)].tolist() for row in best[full]]
        yield pa.table({"a": pa.array(np.full(len(full), one.number)), "pos": pa.array(full.astype(np.int32)), "near": pa.array(near, pa.list_(pa.float64()))})

    kind = "a long, pos int, near array<double>"

    def best(found: DataFrame) -> DataFrame:
        flat = found.select("a", "pos", F.explode("near").alias("d"))
        first = flat.withColumn("n", F.row_number().over(Window.partitionBy("a", "pos").orderBy("d"))).filter(F.col("n") <= k)
        return first.groupBy("a", "pos").agg(F.array_sort(F.collect_list("d")).alias("near"))

    seeds = written(here.pairs(there, nearest), "seed-pairs")
    first = written(best(here.met(there, seeds, compare, kind)), "seed-neighbours")
    places = here.blocks.select(F.col("block").alias("a"), F.explode(F.sequence(F.lit(0), F.col("rows").cast("int") - 1)).alias("pos"))
    bounds = places.join(first, ["a", "pos"], "left").select("a", "pos", F.when(F.size("near") >= k, F.element_at("near", k)).otherwise(F.lit(float("inf"))).alias("bound"))
    of_block = written(bounds.groupBy("a").agg(F.max("bound").alias("radius"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "bound"))), lambda x: x["bound"]).alias("bounds")), "bounds")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array([np.asarray(x, np.float64).tobytes() for x in batch.column("bounds").to_pylist()], pa.binary())], names=["block", "more"])

    rest = written(here.pairs(there, within, of_block.select(F.col("a").alias("block"), "radius")).join(seeds, ["a", "b"], "left_anti"), "rest-pairs")
    if report is not None:
        report |= {"pairs": here.blocks.count() * there.blocks.count(), "compared": seeds.count() + rest.count()}
    second = here.met(there, rest, compare, kind, of_block.select("a", "bounds").mapInArrow(pack, "block long, more binary"))
    near = best(first.unionByName(second))
    key_type = schema[key].dataType

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, packed in zip(batch.column("block").to_pylist(), batch.column("keys"), strict=True):
                with pa.ipc.open_stream(packed.as_buffer()) as source:
                    t = source.read_all().combine_chunks()
                yield from pa.table({"a": pa.array([number] * t.num_rows, pa.int64()), "pos": pa.array(np.arange(t.num_rows, dtype=np.int32)), key: t.column(key)}).to_batches()

    named = here.blocks.select("block", "keys").mapInArrow(keys, T.StructType([T.StructField("a", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField(key, key_type)]))
    return named.join(near, ["a", "pos"], "left").select(key, F.coalesce("near", F.array().cast("array<double>")).alias("near"))


def _mean_or_zero(near: DataFrame, key: str, out: str) -> DataFrame:
    total = F.aggregate("near", F.lit(0.0), lambda a, x: a + x)
    return near.select(key, F.when(F.size("near") > 0, total / F.size("near")).otherwise(F.lit(0.0)).alias(out))


def novelty_knn(df: DataFrame, key: str, vector: str, scene: str, index: str, k: int = 10, min_gap: int = 4, out: str = "nov_knn", **options: int) -> DataFrame:
    """Mean of 1 - cosine over the k most similar rows of other scenes; a pool of one scene uses rows at least ``min_gap`` frames away."""
    single = df.select(scene).distinct().limit(2).count() <= 1
    near = knn_distances(df, df, key, vector, k, "cosine", scene, index if single else None, min_gap, **options)
    return _mean_or_zero(near, key, out)


def rarity_knn(df: DataFrame, key: str, vector: str, scene: str, valid: str | None = None, k: int = 10, out: str = "rarity", **options: int) -> DataFrame:
    """Mean Euclidean distance to the k nearest valid rows of other scenes; 0 without candidates."""
    near = knn_distances(df, df.filter(F.col(valid)) if valid else df, key, vector, k, "l2", scene, **options)
    return _mean_or_zero(near, key, out)


def novelty_to_seed(df: DataFrame, seed: DataFrame, key: str, vector: str, metric: str = "l2", out: str = "novelty", **options: int) -> DataFrame:
    """Distance to the nearest vector of a reference set; 0 when it is empty."""
    return _mean_or_zero(knn_distances(df, seed, key, vector, 1, metric, **options), key, out)


def query_scores(df: DataFrame, key: str, vector: str, queries: Sequence[tuple[str, Sequence[float]]]) -> DataFrame:
    """Best similarity to a few query vectors and the first query that reaches it; the queries are literals of the plan."""
    if not queries:
        raise ValueError("at least one query is needed")
    v = F.col(vector).cast("array<double>")
    sims = [F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in q]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for _, q in queries]
    scored = df.select(key, F.array(*sims).alias("__s"))
    ids = F.array(*[F.lit(i) for i, _ in queries])
    return scored.select(key, F.array_max("__s").alias("qry_max"), F.element_at(ids, F.array_position("__s", F.array_max("__s")).cast("int")).alias("qry_best"))


def vector_classes(df: DataFrame, key: str, vector: str) -> DataFrame:
    """class (smallest key), members, v (the vector) of each distinct vector; rows without a vector have none."""
    rows = df.select(F.col(key).alias("__k"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    return rows.groupBy("v").agg(F.min("__k").alias("class"), F.count(F.lit(1)).alias("members"))


def _close(classes: DataFrame, theta: float, carried: list[str], found: Callable[[Block, Block, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: T.StructType, block_rows: int | None, report: dict[str, int] | None) -> DataFrame:
    """``found`` of the classes whose vectors' inner product is above ``theta``: two blocks, places in them, products; a tile of the block pair at a time."""
    index = PivotIndex.build(classes, "v", carried, block_rows=block_rows)

    def may(a: Summaries, b: Summaries, gap: np.ndarray) -> np.ndarray:
        most = (a.norm[:, None] + b.norm[None] - gap * gap) / 2
        return (most > theta - 1e-9 * (1 + np.abs(most))) & (a.block[:, None] <= b.block[None])

    def compare(one: Block, partners: Iterator[Block]) -> Iterator[pa.Table]:
        for other in partners:
            for at in _tiles(len(one.vectors), len(other.vectors)):
                s = one.vectors[at] @ other.vectors.T
                i, j = np.nonzero(s > theta)
                keep = at.start + i < j if one.number == other.number else np.ones(len(i), bool)
                i, j = i[keep], j[keep]
                yield found(one, other, at.start + i, j, s[i, j])

    pairs = written(index.pairs(index, may), "class-pairs")
    if report is not None:
        blocks = index.blocks.count()
        report |= {"pairs": blocks * (blocks + 1) // 2, "compared": pairs.count()}
    return index.met(index, pairs, compare, schema)


def _class_pairs(classes: DataFrame, theta: float, block_rows: int | None, report: dict[str, int] | None) -> DataFrame:
    """a < b, cos: the classes whose vectors' inner product is above ``theta``."""

    def named(one: Block, other: Block, i: np.ndarray, j: np.ndarray, cos: np.ndarray) -> pa.Table:
        return pa.table({"a": one.keys.column("class").take(pa.array(i)), "b": other.keys.column("class").take(pa.array(j)), "cos": pa.array(cos)})

    kind = classes.schema["class"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("cos", T.DoubleType())])
    return _close(classes, theta, ["class"], named, schema, block_rows, report).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cos")


def _count_close(classes: DataFrame, theta: float, block_rows: int | None) -> int:
    """Pairs of members of different classes above ``theta``; counted where they are found, so a tile sends one number and not its pairs."""

    def counted(one: Block, other: Block, i: np.ndarray, j: np.ndarray, cos: np.ndarray) -> pa.Table:
        m, o = (x.keys.column("members").to_numpy()[at] for x, at in ((one, i), (other, j)))
        return pa.table({"close": [int(m @ o)]})

    schema = T.StructType([T.StructField("close", T.LongType())])
    return _close(classes, theta, ["members"], counted, schema, block_rows, None).agg(F.sum("close")).first()[0] or 0


def similar_pairs(df: DataFrame, key: str, vector: str, theta: float, block_rows: int | None = None, report: dict[str, int] | None = None) -> DataFrame:
    """a < b, cos: pairs with cosine above ``theta`` (strict) between distinct vectors, each named by its smallest key (``vector_classes`` has the members)."""
    return _class_pairs(vector_classes(df, key, vector), theta, block_rows, report)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and root of all edges of a task by union-find."""
    up: dict = {}

    def root(x):  # type: ignore[no-untyped-def]
        while (above := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(above, above)
            x = above
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            up[root(b)] = root(a)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(x) for x in list(up)], kind)], names=["node", "to"])


def connected_groups(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``key`` and ``group``: the smallest key that can be reached.

    Every round each node joins the neighbour (or itself) that comes first in an order by a
    hash that changes from round to round, and the graph is contracted, so the number of
    rounds grows with the logarithm of the number of nodes, chains in key order included.
    A node with very many edges only meets minima that are combined before the exchange.
    One task ends the work once at most ``TAIL`` edges are left."""
    rest = written(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    steps: list[DataFrame] = []
    kind = edges.schema["a"].dataType
    while n := rest.count():
        if n <= TAIL:
            steps.append(written(rest.coalesce(1).mapInArrow(_joined, T.StructType([T.StructField("node", kind), T.StructField("to", kind)])), "steps"))
            break
        order = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), c), F.col(c).alias("k"))  # noqa: B023, E731
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.least(F.min(order("b")), F.min(order("a")))["k"].alias("to")).select(F.col("a").alias("node"), "to"), "steps")
        steps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("x")).hint("merge")
        right = step.select(F.col("node").alias("b"), F.col("to").alias("y")).hint("merge")
        rest = written(rest.join(left, "a").join(right, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    found = nodes.select(F.col(key).alias("k"), F.col(key).alias("root"))
    for step in steps:
        onward = step.select(F.col("node").alias("root"), F.col("to").alias("next")).hint("merge")
        found = found.join(onward, "root", "left").select("k", F.coalesce("next", "root").alias("root"))
    if steps:
        found = written(found, "roots")
    smallest = found.groupBy("root").agg(F.min("k").alias("group"))
    return found.join(smallest.hint("merge"), "root").select(F.col("k").alias(key), "group")


def duplicate_groups(df: DataFrame, key: str, vector: str, theta: float = 0.95, block_rows: int | None = None) -> DataFrame:
    """``key`` and ``group``: smallest key reached over cosines above ``theta``; equal vectors follow their class if its own product is above ``theta``."""
    classes = written(vector_classes(df, key, vector), "classes")
    groups = connected_groups(classes, _class_pairs(classes, theta, block_rows, None), "class")
    own = classes.select("v", "class", (F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) > theta).alias("close")).join(groups.hint("merge"), "class")
    rows = df.select(F.col(key).alias("__k"), F.col(vector).cast("array<double>").alias("v"))
    member = rows.join(own.hint("merge"), "v", "left")
    return member.select(F.col("__k").alias(key), F.when(F.coalesce("close", F.lit(False)), F.col("group")).otherwise(F.col("__k")).alias("group"))


def pair_redundancy(df: DataFrame, key: str, vector: str, theta: float = 0.95, block_rows: int | None = None) -> DataFrame:
    """Share of pairs of a selection above theta; 0 for fewer than two rows.  Pairs of equal vectors are counted from the sizes of their classes."""
    n = df.count()
    classes = written(vector_classes(df, key, vector), "classes")
    between = _count_close(classes, theta, block_rows)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    inside = classes.filter(square > theta).agg(F.sum(F.col("members") * (F.col("members") - 1) / 2)).first()[0] or 0
    close, pairs = int(between + inside), n * (n - 1) // 2
    return df.sparkSession.createDataFrame([(n, close, close / pairs if pairs else 0.0)], "n long, close long, redundancy double")


def mean_vector(df: DataFrame, key: str, vector: str, chosen: str | None = None, normalise_first: bool = False) -> DataFrame:
    """L2-normalised mean over the chosen rows of a key, over all its rows if none is chosen (norm floor 1e-12)."""
    base = df.select(key, (F.col(chosen) if chosen else F.lit(True)).alias("__c"), F.col(vector).cast("array<double>").alias("__v"))
    if normalise_first:
        length = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda s, x: s + x * x))
        base = base.withColumn("__v", F.transform("__v", lambda x: x / F.greatest(length, F.lit(FLOOR))))
    flat = base.select(key, "__c", F.posexplode("__v").alias("p", "x"))
    means = flat.groupBy(key, "p").agg(F.coalesce(F.avg(F.when(F.col("__c"), F.col("x"))), F.avg("x")).alias("m"))
    v = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return v.select(key, F.transform("v", lambda x: x / F.greatest(norm, F.lit(FLOOR))).alias(vector))


def ood_deviation(df: DataFrame, key: str, vector: str, keep: str) -> DataFrame:
    """Distance of each vector from the mean of the kept ones, over the root mean square of theirs."""
    flat = df.select(key, keep, F.posexplode(F.col(vector).cast("array<double>")).alias("p", "x"))
    centre = flat.filter(keep).groupBy("p").agg(F.avg("x").alias("m"))  # one row a dimension
    square = flat.join(F.broadcast(centre), "p").groupBy(key, keep).agg(F.sum((F.col("x") - F.col("m")) ** 2).alias("d2"))
    spread = square.filter(keep).agg(F.sqrt(F.avg("d2")).alias("spread"))
    return square.crossJoin(F.broadcast(spread)).select(key, F.sqrt("d2").alias("deviation"), "spread")


def embed_blocks(df: DataFrame, key: str, blocks: Sequence[str], keep: str, dim: int = 64, drop: Sequence[str] = (), out: str = "embedding") -> DataFrame:
    """z-scores by block, blocks weighted by 1 / sqrt(width), PCA fitted on kept rows and applied to all.

    Means and deviations are aggregates; the covariance is a sum of per-batch products
    (width^2 numbers, whatever the number of rows), solved on the driver; signs make the
    largest loading of a component positive."""
    used = [b for b in blocks if b not in drop]
    first = df.select(*[F.size(b).alias(b) for b in used]).first()
    if first is None:
        raise ValueError("no rows")
    widths = [first[b] for b in used]
    flat = F.concat(*[F.col(b).cast("array<double>") for b in used])
    rows = df.select(key, F.col(keep).alias("__keep"), flat.alias("__x"))
    width = sum(widths)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, square, n = np.zeros(width), np.zeros(width), 0
        for b in batches:
            x = _matrix(b["__x"])
            if len(x):
                total, square, n = total + x.sum(0), square + (x * x).sum(0), n + len(x)
        yield pd.DataFrame({"s": [total.tolist()], "q": [square.tolist()], "n": [n]})

    moments = rows.filter("__keep").mapInPandas(sums, "s array<double>, q array<double>, n long").collect()
    n = sum(m["n"] for m in moments)
    if n < 2:
        raise ValueError("fewer than two kept rows")
    mean = np.sum([m["s"] for m in moments], axis=0) / n
    std = np.sqrt(np.maximum(np.sum([m["q"] for m in moments], axis=0) / n - mean**2, 0))
    scale = np.where(std > 1e-9, 1 / np.maximum(std, 1e-9), 0.0) / np.sqrt(np.repeat(widths, widths))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.zeros((width, width))
        for b in batches:
            if len(b):
                z = (_matrix(b["__x"]) - mean) * scale
                c += z.T @ z
        yield pd.DataFrame({"i": np.arange(width), "c": list(c)})

    cov = rows.filter("__keep").mapInPandas(products, "i int, c array<double>").select("i", F.posexplode("c").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    full = np.zeros((width, width))
    full[cov["i"], cov["j"]] = cov["v"]
    d = min(dim, n - 1, width)
    _, vectors = np.linalg.eigh(full)
    axes = vectors[:, ::-1][:, :d]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(d)])

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], out: list(((_matrix(b["__x"]) - mean) * scale) @ axes) if len(b) else []})

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(out, T.ArrayType(T.DoubleType()))])
    return rows.mapInPandas(project, schema)


def concept_scores(df: DataFrame, reference: DataFrame, key: str, concepts: Sequence[str], q: float = 0.995) -> DataFrame:
    """Concepts above their reference percentile: the one with the largest positive margin, and that margin."""
    cuts = reference.agg(*[F.percentile(c, F.lit(q)).alias(c) for c in concepts]).first()
    margins = F.array(*[F.struct((F.col(c) - F.lit(float(cuts[c] or 0))).alias("m"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, c in enumerate(concepts)])
    best = F.array_max(margins)
    hit = best["m"] > 0
    return df.select(key, F.when(hit, best["c"]).otherwise(F.lit("")).alias("concept_top"), F.when(hit, best["m"]).alias("concept_margin"))


Selector = Callable[[Sequence[str], int], list[str]]

"""Hard negatives by a Voronoi-partitioned, distributed kNN join on inner products.

Components become floor(256 x); the score of two rows is the integer inner product of
their vectors.  An anchor's positives are its first ``positives`` other rows of the same
label; for each of them the first ``negatives`` rows of other labels with
low * positive <= 100 * score <= high * positive are its hard negatives.  Higher scores
come first, ties by smaller id.

1. Norm augmentation turns inner products into distances: a candidate x becomes (x,
   sqrt(M^2 - |x|^2)) with M the largest norm, an anchor q becomes (q, 0), and
   |q' - x'|^2 = |q|^2 + M^2 - 2 score.
2. Pivots are a bounded sample of the augmented rows.  Every row is assigned to its
   nearest pivot and keeps its distance to it; cells keep their label counts and radii.
   Anchors form groups around pivots, at most ``GROUP`` each; a group keeps its least and
   largest distance to every pivot.
3. Positives: the cells' counts and radii of a label bound the distance within which a
   group's anchors surely find enough rows; a row goes only to groups of its label whose
   annulus around the row's pivot, widened by that bound, it lies in.
4. Negatives: a positive's score window is a range of distances; a row goes only to
   groups for some anchor of which it might lie in that range.
5. A group meets its rows in blocks of at most about ``BLOCK``; each block gives its best
   rows exactly, from integer products, and one window an anchor merges the blocks.

Scale: pivots (at most ``PIVOTS`` rows) are all that is broadcast.  A cell with a third
of all rows, or of equal vectors, is dealt into blocks by row like any other.  Bounds
only save work: a row that might serve a group always goes there, so results are exact.

Edge cases: rows with a null label or vector, or a null or non-finite component, take no
part; a null id is no anchor and sorts last among equal scores; repeated rows are rows of
their own, and all that an anchor leaves out is its own row; vectors shorter than the
longest are filled up with zeros; an empty table, or one without anchors, gives an empty
result; components so large that a score could pass 2^62 are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import grows, quoted, store

#: Most pivots, rows a pivot at least, and about how many anchors stand in a group and candidates in a block.
PIVOTS, ROWS_A_PIVOT, GROUP, BLOCK = 128, 2_000, 512, 32_768
#: Slack of the bounds as a share of the largest norm, far above the rounding of double distances.
SLACK = 1e-5
#: Stands for a null id, which sorts last.
NO_ID = (1 << 63) - 1


def quantised(rows: DataFrame, vec_id: str, vector: str, label: str, anchor: Column | None, flip: Column | None) -> DataFrame:
    """row, id, label, q (array of long), anchor: the rows that take part; where ``flip`` holds, the label is the next of ten."""
    own = quoted(label).cast("long")
    named = rows.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(quoted(vec_id).cast("long"), F.lit(NO_ID)).alias("id"), quoted(vector).cast("array<double>").alias("v"),
        (own if flip is None else F.when(F.coalesce(flip, F.lit(False)), F.pmod(own + 1, F.lit(10))).otherwise(own)).alias("label"), F.coalesce(F.lit(True) if anchor is None else anchor, F.lit(False)).alias("anchor"),
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    taking = F.coalesce(F.col("v").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    return named.filter(taking).select("row", "id", "label", F.transform("v", lambda x: F.floor(x * 256).cast("long")).alias("q"), (F.col("anchor") & (F.col("id") != NO_ID)).alias("anchor"))


class Space:
    """Pivots in the augmented space, and distances to them."""

    def __init__(self, norm: float, width: int):
        self.norm, self.width, self.pivots = norm, width, np.empty((0, width + 1))

    def unpacked(self, column: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(column), np.int64).reshape(len(column), self.width)

    def augmented(self, q: np.ndarray, anchor: bool) -> np.ndarray:
        x = q.astype(np.float64)
        return np.column_stack([x, np.zeros(len(x)) if anchor else np.sqrt(np.maximum(self.norm - (x * x).sum(1), 0))])

    def distances(self, q: np.ndarray, anchor: bool) -> np.ndarray:
        x = self.augmented(q, anchor)
        square = (x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None] - 2 * (x @ self.pivots.T)
        return np.sqrt(np.maximum(square, 0))


def _padded(lists: pa.ListArray, width: int) -> np.ndarray:
    sizes = np.diff(lists.offsets.to_numpy())
    q = np.zeros((len(lists), width), np.int64)
    q[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return q


def _assigned(rows: DataFrame, space: Space) -> DataFrame:
    """The rows with their packed vector, their cell and their distance to its pivot."""
    held = rows.sparkSession.sparkContext.broadcast(space)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.value
        for batch in batches:
            if batch.num_rows:
                q = _padded(batch.column("q"), s.width)
                d = s.distances(q, False)
                cell = d.argmin(1)
                packed = pa.array([x.tobytes() for x in q], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("row", "id", "label", "anchor")), packed, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(q)), cell])], names=["row", "id", "label", "anchor", "q", "cell", "dist"]
                )

    return rows.mapInArrow(assign, "row long, id long, label long, anchor boolean, q binary, cell int, dist double")


def _grouped(anchors: DataFrame, space: Space, most: int) -> DataFrame:
    """Anchors with their group (grp), their squared norm, and their distance to every pivot (far): groups lie around a few pivots and are split to about ``most`` rows."""
    held = anchors.sparkSession.sparkContext.broadcast(space)
    around = max(1, min(len(space.pivots), anchors.count() // most))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = held.value
        for b in batches:
            if len(b):
                q = s.unpacked(b["q"])
                d = s.distances(q, True)
                yield b.assign(near=d[:, :around].argmin(1), square=(q.astype(np.float64) ** 2).sum(1), far=list(d))

    found = store(anchors.select("row", "id", "label", "q").mapInPandas(near, "row long, id long, label long, q binary, near int, square double, far array<double>"), "anchors")
    parts = found.groupBy("near").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))  # a row a pivot
    return found.join(F.broadcast(parts), "near").withColumn("grp", F.col("near") * F.lit(1 << 32) + F.pmod(F.xxhash64("row"), F.col("parts")))


def _met(served: DataFrame, anchors: DataFrame, columns: list[str], blocks: int, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work(anchors, candidates)`` for every group and each block of the rows that serve it."""
    left = anchors.select("grp", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), *columns)
    right = served.select("grp", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "row", "id", "label", "q")
    return left.groupBy("grp", "block").cogroup(right.groupBy("grp", "block")).applyInPandas(work, schema)


def _scored(a: pd.DataFrame, c: pd.DataFrame, space: Space, exact: bool, part: int = 64) -> Iterator[tuple[Any, np.ndarray]]:
    """Each anchor with its integer scores; through doubles where these are exact."""
    if not len(a) or not len(c):
        return
    kind = np.float64 if exact else np.int64
    across = space.unpacked(c["q"]).astype(kind).T
    own = space.unpacked(a["q"]).astype(kind)
    for at, anchor in enumerate(a.drop(columns="q").itertuples(index=False)):
        if at % part == 0:
            scores = (own[at : at + part] @ across).astype(np.int64)
        yield anchor, scores[at % part]


def _table(found: list[tuple[np.ndarray, ...]], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k, n in enumerate(names)})


def mine(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", anchor: Column | None = None, flip: Column | None = None,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, pivots: int = PIVOTS, group: int = GROUP, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score (longs).

    ``anchor`` and ``flip`` are conditions on the columns of ``rows``: which rows are
    anchors (all unless given), and whose label becomes the next of ten before use."""
    taking = store(quantised(rows, vec_id, vector, label, anchor, flip), "quantised")
    square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    peak = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: F.greatest(s, F.abs(x)))
    n, width, norm, largest = taking.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(square), F.max(peak)).first()
    width, bound = max(1, width or 1), (largest or 0) ** 2 * max(1, width or 1)
    if bound >= 1 << 62:
        raise ValueError("components are too large for integer scores")
    exact, blocks = bound < 1 << 53, max(1, -(-n // block))
    space = Space(float(norm or 0), width)
    sample = taking.orderBy(F.xxhash64("q", "id", "row"), "row").limit(min(pivots, max(1, n // ROWS_A_PIVOT))).select("q").toArrow()
    if n:
        space.pivots = space.augmented(_padded(sample.column("q").combine_chunks(), width), False)
    cells = store(_assigned(taking, space), "cells")
    anchors = store(_grouped(cells.filter("anchor"), space, group), "anchor-groups")
    slack = SLACK * (1 + space.norm**0.5)

    # positives: a row of the label within the distance that surely holds enough of them
    annuli = anchors.select("grp", "label", F.posexplode("far").alias("cell", "d")).groupBy("grp", "label", "cell").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    of_label = cells.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("members"), F.max("dist").alias("radius"))
    reach = annuli.join(of_label, ["label", "cell"]).withColumn("reach", F.col("hi") + F.col("radius"))
    sure = reach.withColumn("sure", F.sum("members").over(Window.partitionBy("grp", "label").orderBy("reach", "cell")))
    bounds = sure.groupBy("grp", "label").agg(F.min(F.when(F.col("sure") > positives, F.col("reach"))).alias("bound"))  # one of them may be the anchor itself
    rings = store(annuli.join(bounds, ["grp", "label"]), "positive-rings")
    gap = F.greatest(F.col("lo") - F.col("dist"), F.col("dist") - F.col("hi"))
    served = cells.join(grows(rings), ["label", "cell"]).filter(F.col("bound").isNull() | (gap <= F.col("bound") + slack))

    def near(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        ids, labels, numbers = c["id"].to_numpy(), c["label"].to_numpy(), c["row"].to_numpy()
        for own, score in _scored(a, c, space, exact):
            mates = np.flatnonzero((labels == own.label) & (numbers != own.row))
            if len(mates) > positives:
                cut = np.partition(score[mates], len(mates) - positives)[len(mates) - positives]
                mates = mates[score[mates] >= cut]
            mates = mates[np.lexsort((numbers[mates], ids[mates], -score[mates]))[:positives]]
            found.append((np.full(len(mates), own.row), numbers[mates], ids[mates], score[mates]))
        return _table(found, ["anchor", "mate", "mate_id", "mate_score"])

    mates = _met(served, anchors, ["row", "label", "q"], blocks, near, "anchor long, mate long, mate_id long, mate_score long")
    first = Window.partitionBy("anchor").orderBy(F.col("mate_score").desc(), "mate_id", "mate")
    best = store(mates.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= positives).filter("mate_score >= 0"), "positives")  # below 0 no score is in the window

    # negatives: rows that may lie within the distances of some score window
    listed = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("n", "mate", "mate_id", "mate_score"))).alias("m"))
    with_mates = store(anchors.join(grows(listed.withColumnRenamed("anchor", "row")), "row").select(*anchors.columns, *[F.col("m")[c].alias(c) for c in ("mate", "mate_id", "mate_score")]), "anchors-with-positives")
    distance = lambda share, score: F.sqrt(F.greatest(F.lit(0.0), F.col("square") + space.norm - F.lit(share / 50) * score))
    windows = with_mates.select("grp", distance(high, F.array_max("mate_score")).alias("nearest"), distance(low, F.array_min("mate_score")).alias("farthest"), F.posexplode("far").alias("cell", "d"))
    around = store(windows.groupBy("grp", "cell").agg(F.min(F.col("d") - F.col("farthest")).alias("inner"), F.max(F.col("d") + F.col("farthest")).alias("outer"), F.min(F.col("nearest") - F.col("d")).alias("beyond")), "negative-rings")
    inside = (F.col("dist") >= F.greatest("inner", "beyond") - slack) & (F.col("dist") <= F.col("outer") + slack)
    asked = cells.join(grows(around), "cell").filter(inside)

    def hard(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        ids, labels, numbers = c["id"].to_numpy(), c["label"].to_numpy(), c["row"].to_numpy()
        for own, score in _scored(a, c, space, exact):
            far = np.flatnonzero((labels != own.label) & (100 * score >= low * min(own.mate_score)) & (100 * score <= high * max(own.mate_score)))
            far = far[np.lexsort((numbers[far], ids[far], -score[far]))]
            falling = -100 * score[far]
            for mate, mate_id, top in zip(own.mate, own.mate_id, own.mate_score, strict=True):
                begin, stop = np.searchsorted(falling, -high * top), np.searchsorted(falling, -low * top, "right")
                hits = far[begin : min(stop, begin + negatives)]
                found.append((*(np.full(len(hits), x, np.int64) for x in (own.row, own.id, mate, mate_id, top)), numbers[hits], ids[hits], score[hits]))
        return _table(found, ["anchor", "anchor_id", "mate", "mate_id", "positive_score", "other", "other_id", "negative_score"])

    schema = "anchor long, anchor_id long, mate long, mate_id long, positive_score long, other long, other_id long, negative_score long"
    pairs = _met(asked, with_mates, ["row", "id", "label", "q", "mate", "mate_id", "mate_score"], blocks, hard, schema)
    order = Window.partitionBy("anchor", "mate").orderBy(F.col("negative_score").desc(), "other_id", "other")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", known("mate_id").alias("positive_id"), "rank", known("other_id").alias("negative_id"), "positive_score", "negative_score")

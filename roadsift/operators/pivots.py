"""A pivot index over vectors: blocks of near rows with their ranges of distances to a few pivots, and block pairs that triangle bounds cannot rule out.

Rows are sorted by (nearest pivot, distance to it) over the whole table and cut into
blocks of bounded bytes, each one row of the index: packed vectors, keys, and for every
pivot the least and largest distance.  For blocks A and B and any pivot p every pair of
rows is at least max(lo_A - hi_B, lo_B - hi_A) apart.  With the largest squared norms the
same bound caps the inner product: a . b = (|a|^2 + |b|^2 - |a - b|^2) / 2.

Equal vectors lie side by side and fill as many blocks as they need; no key decides where
a row goes, so no block outgrows its bound.

Planning compares block summaries only (a few hundred bytes a block), slice by slice of
bounded size; what is compared in full is the surviving block pairs, one row each.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written

#: Pivots, rows that they are chosen from, most rows and bytes of a block, and least number of blocks.
PIVOTS, SAMPLE, BLOCK_ROWS, BLOCK_BYTES, LEAST_BLOCKS = 16, 2_048, 8_192, 8 << 20, 8
#: Block summaries that a planning step sends to the executors.
SLICE = 16_384
#: Slack of every bound as a share of the largest norm; far above the rounding of double distances.
SLACK = 1e-6


def farthest_points(sample: np.ndarray, k: int) -> np.ndarray:
    """Up to k rows of a sample, each the farthest from those before it; repeats are left out."""
    if not len(sample):
        return sample
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < k and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


@dataclass
class Summaries:
    """Of each block: its number, rows, ranges of distances to the pivots, and largest squared norm."""

    block: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    norm: np.ndarray

    def apart(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least distance between rows of each block here and rows with the given ranges (one range row each)."""
        gap = np.zeros((len(low), len(self.block)))
        for p in range(self.low.shape[1]):  # one pivot at a time keeps this a plain matrix
            gap = np.maximum(gap, np.maximum(self.low[None, :, p] - high[:, None, p], low[:, None, p] - self.high[None, :, p]))
        return gap


class PivotIndex:
    """``blocks``: block, rows, keys (packed arrays of the key and further columns), vectors (packed doubles), low, high, norm."""

    def __init__(self, blocks: DataFrame, pivots: np.ndarray, width: int, slack: float, count: int):
        self.blocks, self.pivots, self.width, self.slack, self.count = blocks, pivots, width, slack, count

    @classmethod
    def build(cls, rows: DataFrame, vector: str, carried: list[str], pivots: np.ndarray | None = None, block_rows: int | None = None) -> PivotIndex:
        """Index of all rows with a vector; ``carried`` columns travel with them.  Two indexes that meet must share their pivots.

        Without ``block_rows`` a table makes ``LEAST_BLOCKS`` blocks, or more of ``BLOCK_ROWS`` rows."""
        spark = rows.sparkSession
        base = rows.select(*carried, F.col(vector).cast("array<double>").alias("__v")).filter(F.col("__v").isNotNull())
        norm = F.aggregate("__v", F.lit(0.0), lambda s, x: s + x * x)
        n, width, peak = base.agg(F.count(F.lit(1)), F.max(F.size("__v")), F.max(norm)).first()
        width = width or 0
        if pivots is None:
            drawn = base.orderBy(F.xxhash64("__v")).limit(SAMPLE).select("__v").toArrow().column("__v").combine_chunks()  # a bounded sample: pivots change the work, never the result
            pivots = farthest_points(drawn.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(drawn) else np.empty((0, width)), PIVOTS)
        if not n:
            width = pivots.shape[1]
        block_rows = block_rows or min(BLOCK_ROWS, -(-n // LEAST_BLOCKS))
        block_rows = max(1, min(block_rows, BLOCK_BYTES // max(1, 8 * width)))
        held = spark.sparkContext.broadcast(pivots)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d = euclidean(_dense(batch.column("__v"), width), held.value)
                    cell = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=[*batch.schema.names, "__cell", "__d"])

        placed = base.mapInArrow(place, T.StructType([*base.schema.fields, T.StructField("__cell", T.IntegerType()), T.StructField("__d", T.DoubleType())]))
        numbered = written(placed.withColumn("__n", F.monotonically_increasing_id()), "placed")  # ties of equal vectors are parted by row
        parts = max(1, -(-n // (4 * block_rows)))
        sorted_rows = numbered.repartitionByRange(parts, "__cell", "__d", "__n").sortWithinPartitions("__cell", "__d", "__n").withColumn("__part", F.spark_partition_id())
        key_type = T.StructType([base.schema[c] for c in carried])
        arrow_keys = pa.schema([pa.field(f.name, t) for f, t in zip(key_type.fields, [_arrow(f.dataType) for f in key_type.fields], strict=True)])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held_back: list[pa.RecordBatch] = []
            waiting, made = 0, 0

            def blocks(last: bool) -> Iterator[pa.RecordBatch]:
                nonlocal held_back, waiting, made
                table = pa.Table.from_batches(held_back).combine_chunks()
                at = 0
                while waiting - at >= block_rows or (last and at < waiting):
                    part = table.slice(at, block_rows)
                    at += part.num_rows
                    v = _dense(part.column("__v").combine_chunks(), width)
                    d = euclidean(v, held.value)
                    sink = pa.BufferOutputStream()
                    keys = part.select(carried).cast(arrow_keys)
                    with pa.ipc.new_stream(sink, arrow_keys) as out:
                        out.write_table(keys)
                    number = (part.column("__part")[0].as_py() << 32) + made
                    made += 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number]), pa.array([part.num_rows]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()),
                            pa.array([d.min(0).tolist()], pa.list_(pa.float64())), pa.array([d.max(0).tolist()], pa.list_(pa.float64())), pa.array([float((v * v).sum(1).max())]),
                        ],
                        names=["block", "rows", "keys", "vectors", "low", "high", "norm"],
                    )
                held_back = table.slice(at).to_batches()
                waiting -= at

            for batch in batches:
                if batch.num_rows:
                    held_back.append(batch)
                    waiting += batch.num_rows
                    if waiting >= block_rows:
                        yield from blocks(False)
            if waiting:
                yield from blocks(True)

        schema = "block long, rows long, keys binary, vectors binary, low array<double>, high array<double>, norm double"
        return cls(written(sorted_rows.mapInArrow(cut, schema), "pivot-blocks"), pivots, width, SLACK * (1 + float(peak or 0) ** 0.5), n)

    def summaries(self) -> Iterator[Summaries]:
        """All block summaries, a bounded slice at a time."""
        slices = max(1, -(-self.blocks.count() // SLICE))
        for k in range(slices):
            t = self.blocks.filter(F.pmod(F.xxhash64("block"), F.lit(slices)) == k).select("block", "rows", "low", "high", "norm").toArrow()
            if t.num_rows:
                yield _summaries(t)

    def pairs(self, other: PivotIndex, keep: Callable[[Summaries, Summaries, np.ndarray], np.ndarray], extra: DataFrame | None = None) -> DataFrame:
        """a, b: the block pairs (own, other's) for which ``keep(own, others, least distances)`` holds.

        ``extra`` (block, radius) hands each own block a number, in place of its norm, to decide by."""
        spark = self.blocks.sparkSession
        own = self.blocks.select("block", "rows", "low", "high", "norm")
        if extra is not None:
            own = own.drop("norm").join(extra.select("block", F.col("radius").alias("norm")), "block")
        slack = self.slack + other.slack
        out: DataFrame | None = None
        for part in other.summaries():
            held = spark.sparkContext.broadcast(part)

            def plan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # type: ignore[no-untyped-def]
                there = held.value
                for whole in batches:
                    for at in range(0, whole.num_rows, 256):
                        here = _summaries(pa.Table.from_batches([whole.slice(at, 256)]))
                        i, j = np.nonzero(keep(here, there, np.maximum(there.apart(here.low, here.high) - slack, 0)))
                        yield pa.RecordBatch.from_arrays([pa.array(here.block[i]), pa.array(there.block[j])], names=["a", "b"])

            found = own.mapInArrow(plan, "a long, b long")
            out = found if out is None else out.unionByName(found)
        return out if out is not None else spark.createDataFrame([], "a long, b long")

    def met(self, other: PivotIndex, pairs: DataFrame, work: Callable[[Block, Iterator[Block]], Iterator[pa.Table]], schema: str | T.StructType, more: DataFrame | None = None) -> DataFrame:
        """``work(own block, its partners)`` for the block pairs; ``more`` (block, more) adds a packed column to own blocks.

        The last join is sorted by the own block, so its partners come one after the other
        and ``work`` can carry what it has found from one to the next.  Where a task holds
        only some of them, ``work`` is called once for these; so what it returns for a block
        must be mergeable."""
        left = self.blocks.select(F.col("block").alias("a"), F.col("keys").alias("ka"), F.col("vectors").alias("va"))
        if more is not None:
            left = left.join(more.withColumnRenamed("block", "a"), "a")
        else:
            left = left.withColumn("more", F.lit(None).cast("binary"))
        right = other.blocks.select(F.col("block").alias("b"), F.col("keys").alias("kb"), F.col("vectors").alias("vb"))
        width = self.width

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ({c: batch.column(c)[k] for c in ("a", "b", "ka", "va", "kb", "vb", "more")} for batch in batches for k in range(batch.num_rows))
            for number, own in itertools.groupby(rows, lambda r: r["a"].as_py()):
                first = next(own)
                partners = (Block(r["b"].as_py(), r["kb"], r["vb"], width, None) for r in itertools.chain([first], own))
                for found in work(Block(number, first["ka"], first["va"], width, first["more"]), partners):
                    if found.num_rows:
                        yield from found.to_batches()

        return pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").mapInArrow(compare, schema)


class Block:
    """One block as a task sees it."""

    def __init__(self, number: int, keys: pa.Scalar, vectors: pa.Scalar, width: int, more: pa.Scalar | None):
        self.number, self._keys, self.more = number, keys, more
        self.vectors = np.frombuffer(vectors.as_buffer(), np.float64).reshape(-1, width)

    @property
    def keys(self) -> pa.Table:
        with pa.ipc.open_stream(self._keys.as_buffer()) as source:
            return source.read_all().combine_chunks()


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _dense(lists: pa.ListArray, width: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(lists) * width:
        raise ValueError("vectors must have one length")
    return flat.reshape(len(lists), width)


def _summaries(t: pa.Table) -> Summaries:
    t = t.combine_chunks()
    ranges = [np.asarray(t.column(c).to_pylist(), np.float64).reshape(t.num_rows, -1) for c in ("low", "high")]
    return Summaries(t.column("block").to_numpy(), t.column("rows").to_numpy(), *ranges, t.column("norm").to_numpy())

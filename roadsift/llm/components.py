"""Connected components of an edge table by union-find and contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, grows, store


def _forest(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Replaces a task's edges by stars of the same connectivity (union-find); bounded by ``most`` nodes at a time."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> pa.RecordBatch:
        nodes = np.fromiter(parent, np.int64, len(parent))
        roots = np.fromiter(map(find, list(parent)), np.int64, len(parent))
        own = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(roots[own]), pa.array(nodes[own])], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > most:
            yield stars()
            parent.clear()
    if parent:
        yield stars()


#: Edges in a task of union-find, the least number of tasks, and the number of edges up to which one task ends the work.
EDGES, TASKS, TAIL = 250_000, 4, 20_000


def _stars(edges: DataFrame) -> tuple[Stored, bool]:
    """The same connectivity with fewer edges: each task's edges as stars, in tasks of about EDGES edges, so that few rounds are left; and
    whether these are the components themselves, because at most TAIL edges were left and one task took them all."""
    n = edges.count()
    tasks = 1 if n <= TAIL else max(TASKS, -(-n // EDGES))
    return Stored(edges.select("a", "b").coalesce(tasks).mapInArrow(_forest, "a long, b long"), "edges"), tasks == 1


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (a node of it) for every node of ``edges(a long, b long)``; self-loops are allowed.

    Each round gathers edges to stars inside tasks (union-find), joins every node to the smallest of its neighbours and itself, in an
    order that differs from round to round, and contracts, until few edges are left.  The
    number of rounds is logarithmic in the number of nodes for ids that are hashes.  All tables of a round
    are in the shared folder; labels are found by map-side combined minima, so a node
    with very many edges is no hot spot.
    """
    rest, ended = _stars(edges)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    maps: list[DataFrame] = []
    turn = 0
    while not rest.df.isEmpty():
        if ended:
            maps.append(rest.df.select(F.col("b").alias("node"), F.col("a").alias("label")))
            break
        flip = F.lit((0x5DEECE66D2B79F15 * (2 * turn + 1)) % (1 << 63) if turn else 0)
        both = rest.df.select("a", "b").union(rest.df.select("b", "a"))
        label = store(both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(flip)).alias("low")).select(F.col("a").alias("node"), F.least(F.col("low"), F.col("a").bitwiseXOR(flip)).bitwiseXOR(flip).alias("label")), "labels")
        maps.append(label)
        onto = rest.df.join(grows(label.select(F.col("node").alias("a"), F.col("label").alias("x"))), "a").join(grows(label.select(F.col("node").alias("b"), F.col("label").alias("y"))), "b")
        smaller = Stored(onto.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        rest.drop()
        if smaller.df.isEmpty():
            break
        (rest, ended), turn = _stars(smaller.df), turn + 1
        smaller.drop()
    if not maps:
        return nodes.select("node", F.col("node").alias("component"))
    found = maps[0]
    for label in maps[1:]:
        onward = label.select(F.col("node").alias("label"), F.col("label").alias("next"))
        found = found.join(grows(onward), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return nodes.join(grows(found), "node", "left").select("node", F.coalesce("label", "node").alias("component"))

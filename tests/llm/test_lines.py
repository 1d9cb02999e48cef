"""Line de-duplication: distances of many pairs at once, ranks over rounds, and hot buckets without lost pairs."""

from __future__ import annotations

import itertools
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadsift.llm import common, line_dedup


@pytest.mark.parametrize("least", [0.0, 0.3, 0.7, 0.9, 1.0])
def test_similar_lines_of_many_pairs(monkeypatch, least):
    """Against the distance of one pair at a time: plain and other characters, empty lines, groups that end early, long lines."""
    monkeypatch.setattr(line_dedup, "TABLES", 50)
    monkeypatch.setattr(line_dedup, "WIDE", 55)
    rng = random.Random(1)
    pairs = []
    for _ in range(400):
        letters = rng.choice(["ab", "abcdefgh ", "aé漢😀"])
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(70)))
        b = list(a)
        for _ in range(rng.randrange(12)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
        pairs.append((a, "".join(b)))
    got = line_dedup.similar_lines([a.encode() for a, _ in pairs], [b.encode() for _, b in pairs], least)
    assert got.tolist() == [line_dedup.edit_similarity(a, b, least) for a, b in pairs]


def test_rounds_offer_each_pair_once():
    """A crowd in five buckets: over all ranks every pair comes out, in one bucket and one round."""
    rng = np.random.default_rng(1)
    n = 40
    nodes = rng.integers(-(2**63), 2**63, n)
    base = rng.integers(-(2**62), 2**62, 4)
    rows = []
    for key in (0, 3, 4):
        for k in range(n):
            # each half shares all keys, both together those after the SimHash
            words = [int(b) ^ (int(k % 2) << 32) ^ (int(k % 2) << 1) for b in base[:2]] + [int(base[2]), int(base[3])]
            bucket = (key << 32) + (k % 2 if key < 4 else 0)
            rows.append([bucket, 0, 0, 0, int(nodes[k]), int(nodes[k]), 50, *words, key, True])
    rows.sort(key=lambda r: r[0])
    names = ["bucket", "x", "y", "own", "node", "g", "size", *line_dedup.KEYS, "key", "home"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
    seen, done, partners, more = Counter(), 0, 1, True
    while more:
        out = list(line_dedup._compare(partners, [batch], done=done))
        seen.update(p for o in out for p in zip(o.column("a").to_pylist(), o.column("b").to_pylist(), strict=True) if p[0] is not None)
        more = any(m is not None for o in out for m in o.column("more").to_pylist())
        done, partners = partners, partners * 8
    assert set(seen) == {(min(a, b), max(a, b)) for a, b in itertools.combinations(nodes.tolist(), 2)}
    assert set(seen.values()) == {1}


@pytest.mark.parametrize("similarity", [0.5, 0.9, 1.0])
def test_hot_buckets_lose_no_pair(spark, monkeypatch, similarity):
    """Nodes that share one key only: all whose sizes allow the similarity meet in a part of the bucket."""
    monkeypatch.setattr(line_dedup, "HOT", 20)
    sizes = [1 + 3 * k for k in range(60)]
    rows = [(k, *(k * 1_000_003 + j for j in range(4)), s, 0, 7) for k, s in enumerate(sizes)]
    spread = spark.createDataFrame(rows, "node long, high long, low long, least long, next long, size long, key int, bucket long")
    parts: dict[int, list[tuple[int, bool]]] = {}
    for r in line_dedup._members(spread, similarity).collect():
        parts.setdefault(r["bucket"], []).append((r["node"], r["home"]))
    met = Counter((min(a, b), max(a, b)) for p in parts.values() for (a, x), (b, y) in itertools.combinations(p, 2) if x or y)
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if sizes[b] - sizes[a] <= (1 - similarity) * sizes[b] + 1e-9}
    assert want <= set(met) and max(met.values(), default=1) == 1


@pytest.mark.parametrize("cells", [line_dedup.CELLS, 2000])
def test_bands_of_several_words(monkeypatch, cells):
    """Long lines, whose bands take more than one 64-bit number: changed words, moved ends, letters that one side lacks."""
    monkeypatch.setattr(line_dedup, "CROWD", 1)
    monkeypatch.setattr(line_dedup, "CELLS", cells)
    monkeypatch.setattr(line_dedup, "BRIEF", 300)
    rng = random.Random(2)
    left, right = [], []
    for k in range(80):
        words = ["".join(rng.choice("abcdefgé漢" if k % 4 == 0 else "abcdefg") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(20, 400))]
        own = [w for w in words if rng.random() > 0.03]
        for _ in range(int(len(own) * rng.random() * 0.2)):
            own[rng.randrange(len(own))] = "".join(rng.choice("abxyz") for _ in range(rng.randrange(1, 9)))
        left.append(" ".join(words).encode())
        right.append(" ".join(own).encode())
    got = line_dedup.similar_lines(left, right, 0.9).tolist()
    assert got == [line_dedup.edit_similarity(a.decode(), b.decode(), 0.9) for a, b in zip(left, right, strict=True)]
    assert 10 < sum(got) < 70


def test_bounds_before_the_tables():
    """Aligned words never promise fewer edits than there are, and runs of characters never rule out a pair that is near enough."""
    rng = random.Random(3)
    a = [" ".join(rng.choice(["red", "green", "blue", "white", "black"]) + str(rng.randrange(9)) for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    b = [" ".join(rng.sample(x.split(), len(x.split())) if k % 3 == 0 else [w for w in x.split() if rng.random() > 0.1]) for k, x in enumerate(a)]
    exact = [line_dedup._distance(x, y, 1000) if x and y else max(len(x), len(y)) for x, y in zip(a, b, strict=True)]
    for x, y, n in zip(a, b, exact, strict=True):
        assert line_dedup._aligned(x, y) >= n and line_dedup._aligned(x.encode(), y.encode()) >= n
    assert line_dedup._few_runs(tuple(a), tuple(b), np.array(exact)).all()
    assert not line_dedup._few_runs(tuple(a), tuple(x[::-1].upper() for x in a), np.ones(200, int)).any()


def test_buckets_of_several_nodes(spark, monkeypatch):
    """Against counting: nodes that meet in a key, over several packs and shares."""
    monkeypatch.setattr(line_dedup, "HELD", 30)
    monkeypatch.setattr(line_dedup, "SHARE", 100)
    rng = random.Random(4)
    cells = [[rng.choice([0, 5, 2**31, 2**32 - 1, *range(100, 400)]) for _ in range(8)] for _ in range(150)]
    rows = [(k - 75, *((c[2 * j] << 32 | c[2 * j + 1]) - (1 << 64) * (c[2 * j] >> 31) for j in range(4))) for k, c in enumerate(cells)]
    got = Counter(tuple(r) for r in line_dedup._met(spark.createDataFrame(rows, "node long, high long, low long, least long, next long").repartition(3)).select("node", "key", "bucket", "n").collect())
    many = Counter((j, c[j]) for c in cells for j in range(8))
    assert got == Counter((k - 75, j, (j << 32) + c[j], many[j, c[j]]) for k, c in enumerate(cells) for j in range(8) if many[j, c[j]] > 1)


def test_shuffles_of_stored_tables_do_not_stay(spark):
    """The disk that a stored table's query took is free again after it, though the driver still holds what it made."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> set[str]:
        found = files.getAllFiles()
        return {n for k in range(found.size()) if (n := found.apply(k).getName()).startswith("shuffle_")}

    before = shuffled()
    rows = spark.range(5000).withColumn("k", F.col("id") % 700)
    held = rows.groupBy("k").count()
    stored = common.Stored(held, "counts")
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.2)
    assert not left and stored.df.count() == 700
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"

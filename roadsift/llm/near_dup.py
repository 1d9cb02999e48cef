"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

A document is the set of its distinct five-word shingles (ASCII letters lower-cased,
words between ASCII white space; fewer words make one shingle, none make the empty
set, which is linked with nothing).  Two documents are linked when the sets' Jaccard
similarity is at least 0.75; groups are connected components of links.

1. One pass over the texts gives each row its set size, two independent 64-bit digests
   of the set, and 32 band keys of a 128-slot SuperMinHash signature (four slots a
   band).  A pair at the threshold meets in no band with probability 5e-6.
2. Rows of equal sets are one class; classes are the nodes from here on.  (If two
   different sets shared a digest, the second digest would show it and everything
   would run again with another seed.)
3. Candidates.  A bucket (band key) with several classes never emits all pairs: its
   members are compared with its leader.  Buckets whose other members lie in different
   components then compare odd sketches (256 bytes: the parity of the set's elements per
   hash cell), block against block inside a task.  The cells in which two sketches differ
   are at most the elements in which the sets differ, so a pair that differs in more than
   a seventh of its summed sizes is surely no link, and nearly all such pairs go here
   without their texts being read.  Of the others every class offers its 1, then 8, 64,
   ... most similar partners of other components until it has none left, so a group whose
   members are all similar costs about one verified pair a member and bucket, not all
   pairs, and no link between groups is lost.
4. Verification compares full shingle sets made from the whole texts.
5. Union-find merges links (``components.py``).

Scale: hot buckets and hot classes only ever meet in map-side combined minima and in
joins of two exchanged sides that adaptive execution splits.  Every step's table is in
the shared folder.

Edge cases: null text is empty; a null doc_id never becomes a component's id unless all
are null; rows that share a doc_id are told apart by their sets; repeated rows share
their component and their ``kept``; result columns win over carried columns of the same
name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GOLDEN, U64, grows, hash_words, ids_field, mix64, others, quoted, slices, store, utf8, window_hashes
from .components import connected_components

RESULT = ("n_shingles", "component_id", "kept")
WORDS, SIMILARITY = 5, (75, 100)
SLOTS, ROWS = 128, 4
#: Classes in a block of sketches, and bits of an odd sketch.
BLOCK, CELLS = 512, 2048
UNSET = U64(0xFFFFFFFFFFFFFFFF)


def shingles(body: bytes, width: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = body.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.asarray([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    return np.unique(window_hashes(hash_words(words), width))


def super_minhash(elements: np.ndarray, owner: np.ndarray, n: int, slots: int = SLOTS, chunk: int = 150_000) -> np.ndarray:
    """SuperMinHash signatures (n x slots) of ``n`` sets given as flat elements sorted by owner.

    Every element walks its own random permutation of the slots; its step j offers the
    value j + r with r uniform in [0, 1), so the ranks of one element are correlated and
    all different.  A set stops walking as soon as every slot holds a value below the
    next step, which large sets reach after one step.  Values are fixed-point: step in
    the top 16 bits, r in the lower 48.
    """
    signature = np.full((n, slots), UNSET, np.uint64)
    if len(elements):
        first = int(owner[0])
        bounds = np.searchsorted(owner, np.arange(first, n + 1))
        lo = first
        while lo < n:  # whole sets, about `chunk` elements at a time
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo - first] + chunk, "right")) - 1 + first)
            hi = min(hi, n)
            a, b = bounds[lo - first], bounds[hi - first]
            _walk(elements[a:b], owner[a:b] - lo, signature[lo:hi], slots)
            lo = hi
    return signature


def _walk(elements: np.ndarray, owner: np.ndarray, signature: np.ndarray, slots: int) -> None:
    flat = signature.reshape(-1)
    steps = np.arange(slots + 1, dtype=np.uint64) * GOLDEN
    draw = mix64(elements + steps[1])
    slot = ((draw & U64(0xFFFF)) * U64(slots)) >> U64(16)
    np.minimum.at(flat, owner * slots + slot.astype(np.int64), draw >> U64(16))
    going = signature.max(axis=1) >= U64(1 << 48)
    live = going[owner]
    elements, owner, slot = elements[live], owner[live], slot[live]
    if not len(elements):
        return
    walk = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(elements), 1))
    rows = np.arange(len(elements))
    at = slot.astype(np.int64)
    walk[rows, at], walk[:, 0] = walk[:, 0].copy(), walk[rows, at].copy()
    for step in range(1, slots):
        draw = mix64(elements + steps[step + 1])
        at = (step + (((draw & U64(0xFFFF)) * U64(slots - step)) >> U64(16))).astype(np.int64)
        here, there = walk[:, step].copy(), walk[rows, at].copy()
        walk[rows, at], walk[:, step] = here, there
        np.minimum.at(flat, owner * slots + there, (U64(step) << U64(48)) | (draw >> U64(16)))
        going = signature.max(axis=1) >= (U64(step + 1) << U64(48))
        live = going[owner]
        if not live.all():
            elements, owner, walk = elements[live], owner[live], walk[live]
            rows = np.arange(len(elements))
            if not len(elements):
                return


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, slots = signature.shape
    parts = signature.reshape(n, slots // rows, rows)
    key = np.broadcast_to(mix64(np.arange(1, slots // rows + 1, dtype=np.uint64) * GOLDEN), (n, slots // rows)).copy()
    for k in range(rows):
        key = mix64(key * GOLDEN + parts[:, :, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, text: str, doc_id: str, seed: int = 0) -> DataFrame:
    """doc_id, n_shingles, key, proof (two digests of the set) and band keys of each row; the last three null for empty sets."""
    rows = docs.select(quoted(doc_id).alias("doc_id"), utf8(quoted(text)).alias("body"))
    id_type = ids_field(rows, "doc_id")
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *[T.StructField(c, T.LongType()) for c in ("n_shingles", "key", "proof")], T.StructField("bands", T.ArrayType(T.LongType()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", 2000, 8 << 20):
            sets = [shingles(b) for b in batch.column("body").to_pylist()]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            digests = [xxhash.xxh3_128_intdigest(s.tobytes(), seed) for s in sets]
            keys = np.asarray([d >> 64 for d in digests], np.uint64).view(np.int64)
            proofs = np.asarray([d & (2**64 - 1) for d in digests], np.uint64).view(np.int64)
            bands = band_keys(super_minhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets)))
            none = sizes == 0
            offsets = pa.array(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32))
            listed = pa.ListArray.from_arrays(offsets, pa.array(bands.reshape(-1)), mask=pa.array(none))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(id_type), pa.array(sizes), pa.array(keys, mask=none), pa.array(proofs, mask=none), listed],
                names=["doc_id", "n_shingles", "key", "proof", "bands"],
            )

    return rows.mapInArrow(sketch, schema)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of candidate pairs with their texts, those whose full shingle sets are similar enough."""
    known: tuple[int | None, np.ndarray | None] = (None, None)
    for batch in slices(batches, "ta", 2000, 16 << 20):
        keep = []
        for k, (a, ta, tb) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "tb")), strict=True)):
            if known[0] != a:
                known = (a, shingles(ta))
            x, y = known[1], shingles(tb)
            if SIMILARITY[1] * min(len(x), len(y)) < SIMILARITY[0] * max(len(x), len(y)):
                continue
            shared = len(x) + len(y) - len(np.union1d(x, y))
            if SIMILARITY[1] * shared >= SIMILARITY[0] * (len(x) + len(y) - shared):
                keep.append(k)
        if keep:
            yield batch.take(pa.array(keep)).select(["a", "b"])


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` with ``n_shingles``, ``component_id`` (smallest doc_id of the group) and ``kept``.

    ``carry`` names input columns to return besides ``doc_id`` (default none); rows meet
    them by a row number, so null and repeated ids lose and gain none."""
    if carry:
        return _carried(docs, text, doc_id, others(docs.select(*[quoted(c) for c in carry]), (*RESULT, doc_id)))
    plain = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    seed = 0
    while True:
        rows = store(signatures(plain, "text", "doc_id", seed), "sketches")
        classes = store(rows.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), (F.min("proof") == F.max("proof")).alias("sound")), "classes")
        if classes.filter("not sound").isEmpty():
            break
        seed += 1
    links = _links(plain, rows, classes, seed)
    groups = store(connected_components(links), "components")
    named = groups.join(grows(classes.select(F.col("key").alias("node"), "first")), "node")
    ids = store(named.groupBy("component").agg(F.min("first").alias("id")), "component-ids")
    labels = store(groups.join(grows(ids), "component").select(F.col("node").alias("key"), "id"), "component-labels")
    # only classes that are linked or have several rows need their table; all others stand for themselves
    names = store(
        classes.join(grows(labels), "key", "left").filter("n > 1 or id is not null").select("key", F.coalesce("id", "first").alias("id")),
        "group-names",
    )
    found = rows.select("doc_id", "n_shingles", "key").join(grows(names), "key", "left").select("doc_id", "n_shingles", F.coalesce("id", "doc_id").alias("component_id"))
    found = found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return found.withColumnRenamed("doc_id", doc_id)


def _numbered(docs: DataFrame, text: str, doc_id: str, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with a number as a table, and their groups by ids (null last, id, row), so that rows that share an id are told apart."""
    rows = docs.select(quoted(doc_id).alias("__id"), quoted(text).alias("__text"), *[quoted(c).alias(f"__c{k}") for k, c in enumerate(carry)]).withColumn("__row", F.monotonically_increasing_id())
    rows = store(rows, "numbered")
    ids = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    return rows, near_duplicates(rows.select(ids.alias("doc_id"), F.col("__text").alias("text")))


def _carried(docs: DataFrame, text: str, doc_id: str, carry: list[str]) -> DataFrame:
    rows, found = _numbered(docs, text, doc_id, carry)
    told = found.select(F.col("doc_id.row").alias("__row"), "n_shingles", F.col("component_id.id").alias("component_id"))
    met = rows.join(grows(told), "__row").withColumn("kept", F.col("__id").eqNullSafe(F.col("component_id")))
    return met.select(F.col("__id").alias(doc_id), *RESULT, *[F.col(f"__c{k}").alias(c) for k, c in enumerate(carry)])


def _links(plain: DataFrame, rows: DataFrame, classes: DataFrame, seed: int) -> DataFrame:
    """Verified links (a, b) between classes: enough of them to connect every group."""
    bands = rows.filter("key is not null").select(F.explode("bands").alias("bucket"), "key")
    crowded = store(bands.groupBy("bucket").agg(F.min("key").alias("lead"), F.max("key").alias("high")).filter("lead <> high").select("bucket", "lead"), "buckets")
    members = store(bands.join(grows(crowded), "bucket").filter("key <> lead").distinct(), "members")
    pairs = members.select(F.col("lead").alias("a"), F.col("key").alias("b")).distinct()
    involved = store(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(grows(classes), "key").select("key", F.col("first").alias("doc_id")), "involved")
    texts = store(_texts(plain, involved, seed), "texts")
    if texts.count() > involved.count():  # some rows repeat both doc_id and text
        texts = store(texts.groupBy("key").agg(F.first("body").alias("body"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "texts")
    links = store(_verified(pairs, texts), "links")
    tried, partners = store(pairs, "tried"), 1
    while True:
        groups = connected_components(links)
        placed = store(members.join(grows(groups.select(F.col("node").alias("key"), "component")), "key", "left").select("bucket", "key", F.coalesce("component", "key").alias("component")), "placed")
        split = store(placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "split")
        if split.isEmpty():
            return links
        active = placed.join(grows(split), "bucket").join(grows(texts.select("key", F.col("n").alias("size"), "sketch")), "key").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        dealt = active.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"x": F.least("own", "o"), "y": F.greatest("own", "o")})
        dealt = dealt.select("bucket", "x", "y", "own", "key", "component", "size", "sketch").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
        near = store(dealt.mapInArrow(partial(_compare, partners), "a long, b long, more boolean"), "near")
        fresh = store(near.select("a", "b").distinct().join(grows(tried), ["a", "b"], "left_anti"), "fresh")
        links = store(links.union(_verified(fresh, texts)), "links")
        if near.filter("more").isEmpty():
            return links
        tried, partners = store(tried.union(fresh), "tried"), partners * 8


def _compare(partners: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each pair of blocks of a bucket: for every class its ``partners`` most similar classes of other components that may be linked with it, and whether there are more."""
    held: list[dict[str, np.ndarray]] = []

    def pairs() -> pa.RecordBatch:
        t = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        left, right = np.flatnonzero(t["own"] == t["x"]), np.flatnonzero(t["own"] == t["y"])
        sketches, size, component, key = t["sketch"][right], t["size"], t["component"], t["key"]
        links: dict[tuple[int, int], bool] = {}
        for i in left:
            apart = np.bitwise_count(sketches ^ t["sketch"][i]).sum(axis=1, dtype=np.int64)
            both = size[right] + size[i]
            found = np.flatnonzero((7 * apart <= both) & (component[right] != component[i]))
            rest = len(found) > partners
            if rest:
                found = found[np.argsort(apart[found] / both[found], kind="stable")[:partners]]
            for j in right[found]:
                pair = (int(key[i]), int(key[j])) if key[i] < key[j] else (int(key[j]), int(key[i]))
                links[pair] = links.get(pair, False) or rest
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(list(links.values()), pa.bool_())], names=["a", "b", "more"])

    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "x", "y", "own", "key", "component", "size")}
        t["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(batch.num_rows, CELLS // 64)
        ends = np.flatnonzero((np.diff(t["bucket"]) != 0) | (np.diff(t["x"]) != 0) | (np.diff(t["y"]) != 0)) + 1
        for lo, hi in zip([0, *ends], [*ends, batch.num_rows], strict=True):
            who = (t["bucket"][lo], t["x"][lo], t["y"][lo])
            if held and who != current:
                yield pairs()
                held.clear()
            current = who
            held.append({c: v[lo:hi] for c, v in t.items()})
    if held:
        yield pairs()


def _texts(plain: DataFrame, involved: DataFrame, seed: int) -> DataFrame:
    """key and whole text of one row of each involved class; rows that merely share the doc_id are dropped by their digest."""
    met = plain.select("doc_id", utf8("text").alias("body")).alias("d").join(grows(involved.alias("i")), F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")))
    return met.select("i.key", "d.body").mapInArrow(partial(_of_class, seed), "key long, body binary, n long, sketch binary")


def _of_class(seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "body", 1000, 8 << 20):
        sets = [shingles(body) for body in batch.column("body").to_pylist()]
        own = [k for k, (key, s) in enumerate(zip(batch.column("key").to_pylist(), sets, strict=True)) if _digest(s, seed) == key]
        if own:
            rows = batch.take(pa.array(own))
            sketch = pa.array([odd_sketch(sets[k]) for k in own], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("body"), pa.array([len(sets[k]) for k in own], pa.int64()), sketch], names=["key", "body", "n", "sketch"])


def odd_sketch(elements: np.ndarray) -> bytes:
    """One bit a cell: whether an odd number of elements fall into it."""
    cells = (mix64(elements ^ GOLDEN) & U64(CELLS - 1)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=CELLS) & 1).tobytes()


def _digest(found: np.ndarray, seed: int) -> int:
    high = xxhash.xxh3_128_intdigest(found.tobytes(), seed) >> 64
    return high - (1 << 64) if high >= 1 << 63 else high


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("key").alias("a"), F.col("body").alias("ta"))
    right = texts.select(F.col("key").alias("b"), F.col("body").alias("tb"))
    return pairs.join(grows(left), "a").join(grows(right), "b").select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long").distinct()


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the row of the smallest doc_id of each group, columns unchanged.

    Rows meet their verdict by a row number of a table in the shared folder, so repeated
    doc_ids are told apart."""
    rows, found = _numbered(docs, text, doc_id, docs.columns)  # of rows that share a doc_id and lie in one group the first stays
    kept = found.filter("kept").select(F.col("doc_id.row").alias("__row"))
    return rows.join(grows(kept), "__row").select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(docs.columns)])

"""Benchmark decontamination by winnowing: fingerprints of documents meet those of benchmark items, and hits are extended to whole shared windows.

A window is ``window`` (10) consecutive words of an item; an item of fewer words is one
window of its own length.  The fingerprint of a window is the smallest of its k-gram
hashes (k = ``gram`` = 5, or the window's length if that is less), so each run of 10
shared words has the same fingerprint on both sides: no shared window can be missed.

1. Items give their windows with fingerprints; equal windows are one row with the set of
   their items.
2. The fingerprints fill a bitmap of 2^20 to 2^27 bits (at most 16 MB, whatever the size
   of the benchmark), which goes to the executors.
3. One pass over the texts slides the same minima; a place whose fingerprint is in the
   bitmap is a hit and leaves with the words of its window.  Nothing else leaves.
4. Hits join the windows of the items on fingerprint and words, so hash collisions and
   false positives of the bitmap end here.  Overlapping windows are merged to spans.

Scale: texts are read once and never shuffled; documents without a hit are never
shuffled at all.  A passage that a third of all documents share is one row of the item
side, and adaptive execution splits its join partition.  Items with a common window are
one set, so neither side multiplies the other.

Edge cases: a null text has no words; a null item_id hits words but is no item to report;
rows that share an item_id are one item; rows that share a doc_id, and repeated rows, are
judged each; an empty benchmark hits nothing; an empty table gives an empty result;
result columns win over carried columns of the same name in any case of letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GOLDEN, U64, hash_bytes, ids_field, mix64, others, quoted, slices, store, utf8, window_hashes
from .words import flat_words, word_bytes

RESULT = ("n_words", "n_hit", "n_items", "item_ids", "spans", "contaminated")
WINDOW, GRAM = 10, 5
#: Bits of the bitmap: 16 a fingerprint within these bounds, as powers of two.
BITS = (20, 27)


def fingerprints(hashes: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and fingerprint of each window of ``length`` words that lies in one text; fingerprints of different lengths differ."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    k = min(gram, length)
    grams = window_hashes(hashes, k)
    low = grams[:n].copy()
    for step in range(1, length - k + 1):
        np.minimum(low, grams[step : step + n], out=low)
    whole = np.arange(length, n + length) <= np.repeat(bounds[1:], np.diff(bounds))[:n]
    return np.flatnonzero(whole), mix64(low[whole] ^ U64(length * int(GOLDEN) % (1 << 64)))


def _phrases(words: pa.Array, firsts: np.ndarray, length: int) -> list[bytes]:
    """The words of each window, parted by blanks."""
    used = np.unique((firsts[:, None] + np.arange(length)).reshape(-1))
    at = np.searchsorted(used, firsts).tolist()
    text = words.take(pa.array(used)).to_pylist()
    return [b" ".join(text[k : k + length]) for k in at]  # the words of a window stand together in `used`


def _item_windows(items: DataFrame, text: str, item_id: str, window: int, gram: int) -> DataFrame:
    """length, key, phrase, items: each distinct window of the benchmark with the ids of its items as sorted strings."""
    rows = items.select(quoted(item_id).cast("string").alias("item"), utf8(quoted(text)).alias("body"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", 2000, 4 << 20):
            words, bounds = flat_words(batch.column("body"))
            data, ends = word_bytes(words)
            hashes = hash_bytes(data, ends[:-1], ends[1:])
            sizes = np.diff(bounds)
            for length in sorted({*sizes[(sizes > 0) & (sizes < window)].tolist(), window}):
                firsts, keys = fingerprints(hashes, bounds, length, gram)
                item = np.searchsorted(bounds, firsts, "right") - 1
                mine = sizes[item] >= window if length == window else sizes[item] == length
                firsts, keys, item = firsts[mine], keys[mine], item[mine]
                if len(firsts):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("item").cast(pa.string()).take(pa.array(item)), pa.array(np.full(len(item), length, np.int32)), pa.array(keys.view(np.int64)), pa.array(_phrases(words, firsts, length), pa.binary())],
                        names=["item", "length", "key", "phrase"],
                    )

    cuts = rows.mapInArrow(cut, "item string, length int, key long, phrase binary")
    return cuts.groupBy("length", "key", "phrase").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _bitmap(windows: DataFrame) -> np.ndarray:
    """Bits of the fingerprints; collected as 64-bit words, of which there are at most 2^BITS[1] / 64."""
    keys = windows.select("key").distinct()
    bits = min(max((16 * keys.count()).bit_length(), BITS[0]), BITS[1])
    slot = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(key & 63 AS int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint8)


def overlap(
    docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", carry: list[str] | None = None, window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """``carry`` (all columns unless given) of every row of ``docs``, and

    n_words, n_hit (words inside an occurrence of an item's window), n_items, item_ids
    (sorted as strings), spans (first word and the word after the last of each merged
    stretch), contaminated (n_hit > 0).
    """
    spark = docs.sparkSession
    windows = store(_item_windows(items, item_text, item_id, window, gram), "item-windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())
    bitmap = spark.sparkContext.broadcast(_bitmap(windows))
    kept = [c for c in (docs.columns if carry is None else carry) if c in others(docs, RESULT)]
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), *[quoted(c).alias(f"__c{k}") for k, c in enumerate(kept)], utf8(quoted(text)).alias("__body"))
    types = [ids_field(rows, f"__c{k}") for k in range(len(kept))]
    hit = pa.struct([("length", pa.int32()), ("at", pa.int64()), ("key", pa.int64()), ("phrase", pa.binary())])
    schema = T.StructType(
        [T.StructField("__row", T.LongType()), *[T.StructField(f"__c{k}", docs.schema[c].dataType) for k, c in enumerate(kept)], T.StructField("n_words", T.LongType())]
        + [T.StructField("hits", T.ArrayType(T.StructType([T.StructField("length", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("key", T.LongType()), T.StructField("phrase", T.BinaryType())])))]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        mask = U64(len(bits) * 8 - 1)
        for batch in slices(batches, "__body", 4000, 4 << 20):
            words, bounds = flat_words(batch.column("__body"))
            data, ends = word_bytes(words)
            hashes = hash_bytes(data, ends[:-1], ends[1:])
            found: list[tuple[np.ndarray, ...]] = []
            phrases: list[bytes] = []
            for length in lengths:
                firsts, keys = fingerprints(hashes, bounds, length, gram)
                slot = (keys & mask).astype(np.int64)
                near = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                if len(near):
                    found.append((firsts[near], np.full(len(near), length, np.int32), keys[near]))
                    phrases += _phrases(words, firsts[near], length)
            firsts = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
            size = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int32)
            keys = np.concatenate([f[2] for f in found]) if found else np.empty(0, np.uint64)
            owner = np.searchsorted(bounds, firsts, "right") - 1
            order = np.argsort(owner, kind="stable")
            values = pa.StructArray.from_arrays(
                [pa.array(size[order]), pa.array((firsts - bounds[owner])[order]), pa.array(keys[order].view(np.int64)), pa.array(phrases, pa.binary()).take(pa.array(order))], fields=list(hit)
            )
            offsets = np.searchsorted(owner[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays([batch.column("__row"), *[batch.column(f"__c{k}").cast(t) for k, t in enumerate(types)], pa.array(np.diff(bounds)), listed], names=schema.names)

    scanned = store(rows.mapInArrow(scan, schema), "scanned")
    hits = scanned.filter(F.size("hits") > 0).select("__row", F.explode("hits").alias("h")).select("__row", "h.*")
    true_hits = hits.join(windows, ["length", "key", "phrase"]).select("__row", "at", (F.col("at") + F.col("length")).alias("stop"), "items")
    by_place = Window.partitionBy("__row").orderBy("at", "stop")
    reach = F.max("stop").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    spans = (
        true_hits.withColumn("new", (F.col("at") > F.coalesce(reach, F.lit(-1))).cast("int"))
        .withColumn("span", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("__row", "span").agg(F.min("at").alias("start"), F.max("stop").alias("stop"), F.collect_set("items").alias("sets"))
    )
    of_row = spans.groupBy("__row").agg(
        F.sum(F.col("stop") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list("sets"))))).alias("item_ids")
    )
    carried = [F.col(f"__c{k}").alias(c) for k, c in enumerate(kept)]
    none_spans, none_items = F.lit(None).cast("array<struct<start:long,stop:long>>"), F.lit(None).cast("array<string>")

    def result(df: DataFrame) -> DataFrame:
        n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
        ids = F.coalesce("item_ids", F.array().cast("array<string>"))
        return df.select(*carried, "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.coalesce("spans", F.array().cast("array<struct<start:long,stop:long>>")).alias("spans"), (n_hit > 0).alias("contaminated"))

    clean = scanned.filter(F.size("hits") == 0).withColumns({"n_hit": F.lit(None).cast("long"), "spans": none_spans, "item_ids": none_items})
    return result(clean).unionByName(result(scanned.filter(F.size("hits") > 0).join(of_row, "__row", "left")))


def drop_contaminated(docs: DataFrame, items: DataFrame, most_share: float = 0.0, **options: object) -> DataFrame:
    """Rows of ``docs``, with their columns, of whose words at most ``most_share`` stand in a benchmark's windows."""
    judged = overlap(docs.withColumns({"__d": F.struct(*[quoted(c) for c in docs.columns])}), items, carry=["__d"], **options)  # type: ignore[arg-type]
    return judged.filter(F.col("n_hit") <= F.lit(most_share) * F.col("n_words")).select("__d.*")

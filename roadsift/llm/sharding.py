"""Sharding by extendible hashing, in DataFrame operations only.

Every row has a 60-bit hash.  The directory starts as one bucket; a bucket whose bytes
are over the limit is split on the next bit of the hash, all others stay, until every
bucket fits.  A shard is a bucket: its depth and its prefix of the hash.

The directory is worked out from sums of bytes per hash prefix: one aggregation with
map-side combine at a probing depth a few bits below the expected one, then that small
table is rolled up level by level, two rows to one, as long as any bucket fits, and its
shards are handed down again to the probed prefixes the same way.  Buckets that are still too large at the
probing depth (few large rows in one place) are probed again some bits deeper, those
rows alone.  Rows meet the directory in an equi-join on the probed prefix, which a hash
spreads evenly.

Edge cases: null text has 0 bytes; rows whose hashes are equal in all bits, as a row
larger than the limit is by itself, cannot be split: such a shard ends at the first depth
that holds nothing else and is marked ``fits = false``; the hash is of the id and the
text's length, so repeated rows share a shard; result columns win over carried columns of
the same name; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import grows, others, quoted, store

RESULT = ("n_bytes", "shard_depth", "shard_prefix", "shard_bytes", "shard_rows", "fits")
BITS = 60


def row_hash(doc_id: Column, n_bytes: Column) -> Column:
    """60 bits of the MD5 of id and size, so that any SQL engine can recompute them."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), n_bytes.cast("string"))), 1, 15), 16, 10).cast("long")


def shard(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = 1 << 20, carry: list[str] | None = None, probe: int = 6) -> DataFrame:
    """All rows with ``n_bytes`` and their shard: ``shard_depth`` bits, ``shard_prefix`` (their value), ``shard_bytes``, ``shard_rows``, ``fits``.

    ``carry`` names input columns to return besides ``doc_id`` (default none)."""
    carry = [c for c in (carry or []) if c in others(docs, (*RESULT, doc_id))]
    names = {c: f"__c{i}" for i, c in enumerate(carry)}
    size = F.coalesce(F.octet_length(quoted(text).cast("string")), F.lit(0)).cast("long")
    rows = docs.select(quoted(doc_id).alias("__id"), size.alias("n_bytes"), *[quoted(c).alias(n) for c, n in names.items()])
    rows = rows.withColumn("__hash", row_hash(F.col("__id"), F.col("n_bytes")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    known, done = 0, []
    depth = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + probe)
    while True:
        found = _directory(rows, known, depth, limit)
        met = rows.withColumn("__at", F.shiftrightunsigned("__hash", BITS - depth)).join(grows(found), "__at")
        done.append(met.filter(~F.col("deeper")).drop("__at", "deeper"))
        if found.filter("deeper").isEmpty():
            break
        rows = store(met.filter("deeper").select(*rows.columns), "deeper-rows")
        known, depth = depth, min(BITS, depth + 2 + probe)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("__id").alias(doc_id), *[F.col(n).alias(c) for c, n in names.items()], "n_bytes", "shard_depth", "shard_prefix", "shard_bytes", "shard_rows", (F.col("shard_bytes") <= limit).alias("fits"))


def _directory(rows: DataFrame, known: int, depth: int, limit: int) -> DataFrame:
    """For every prefix of ``depth`` bits that has rows, the bucket that it lies in, or ``deeper`` if no bucket up to here fits.

    Buckets at ``known`` bits are known to be too large (0: the whole table is looked at).
    """
    at = f"shiftrightunsigned(__hash, {BITS - depth})"
    sums = (F.sum("b").alias("b"), F.sum("r").alias("r"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    leaves = store(rows.select(F.expr(at).alias("p"), F.col("n_bytes").alias("b"), F.lit(1).cast("long").alias("r"), F.col("__hash").alias("lo"), F.col("__hash").alias("hi")).groupBy("p").agg(*sums), "leaves")
    fits = (F.col("b") <= limit) | (F.col("lo") == F.col("hi"))
    levels = [leaves]
    while depth - len(levels) >= known + (known > 0):
        above = store(levels[-1].withColumn("p", F.shiftright("p", 1)).groupBy("p").agg(*sums), "level")
        if above.filter(fits).isEmpty():
            break
        levels.append(above)
    found = None
    for k in range(len(levels) - 1, -1, -1):
        own = F.when(fits, F.struct(F.lit(depth - k).alias("d"), F.col("p"), F.col("b"), F.col("r")))
        level = levels[k]
        if found is None:
            found = level.select("p", own.alias("s"))
        else:
            over = found.select(F.col("p").alias("up"), F.col("s").alias("given"))
            found = level.join(grows(over), F.shiftright(level["p"], 1) == F.col("up")).select("p", F.coalesce("given", own).alias("s"))
        found = store(found, "directory-level")
    return found.select(F.col("p").alias("__at"), F.col("s").isNull().alias("deeper"), F.col("s.d").alias("shard_depth"), F.col("s.p").alias("shard_prefix"), F.col("s.b").alias("shard_bytes"), F.col("s.r").alias("shard_rows"))

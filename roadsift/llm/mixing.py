"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: every source has a weight and shares the total size by it; no source may get
more than ``most_epochs`` times its own size, and what it cannot take is shared again
among the others.  Blocks of ``block`` words are then seats: sources get them by the
highest quotients target / (2 k + 1), and the seats of a source are divided among all its
shards by the same rule with the shards' sizes, no shard getting more seats than
``most_epochs`` of its words fill, which gives every (source, shard) an integer quota.  Inside a shard the source's documents stand in a seeded order; the
quota takes whole passes over them, and the remaining blocks are a run that starts at a
seeded block and wraps around.

Scale: words are counted in the scan.  A source is cut into hash classes of about
``shard_docs`` documents, its shards, so the only ordered windows are over one shard of
one source, whatever a source's share.  The driver sees one row per source.  Shards get
their seats by one divisor per source, narrowed for all sources at once by sums over the
shards (``ROUNDS`` jobs), so any number of shards is one apportionment; only the quotients
between the last two divisors, a few in ten thousand, are ranked one by one.

Edge cases: null text has size 0 and is never taken; sources stand in code point order
with null last; repeated rows are documents of their own, and null ids are dealt by row
number; result columns win over carried columns of the same name; a corpus without words
takes nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import grows, others, quoted, store

RESULT = ("size", "source_size", "target", "taken")
PLACES = ("shard", "passes", "from_word", "to_word", "wrapped")
#: Sources up to which their table (about 50 bytes a source) is broadcast.
BROADCAST_SOURCES = 50_000
#: Divisors looked at in one pass over the shards, and passes.
DIVISORS, ROUNDS = 16, 4
WORD = r"[^\x20\x09-\x0D]+"


def sainte_lague(weights: Sequence[float], seats: int) -> np.ndarray:
    """Seats by the highest quotients weight / (2 k + 1); equal quotients go to the earlier entry.

    The divisor form: round(w / d) seats each for the right divisor d, found by
    bisection; the few seats that are then left over or too many go by quotient.
    """
    w = np.asarray(weights, float)
    out = np.zeros(len(w), np.int64)
    if seats <= 0 or not (w > 0).any():
        return out
    low, high = w.sum() / (seats + len(w)) / 2, w.sum() / max(seats, 1) * 4 + w.max() * 2
    for _ in range(200):
        mid = (low + high) / 2
        if np.floor(w / mid + 0.5).sum() > seats:
            low = mid
        else:
            high = mid
    out = np.floor(w / high + 0.5).astype(np.int64)
    while (left := int(seats - out.sum())) > 0:
        out[np.argsort(-w / (2 * out + 1), kind="stable")[: min(left, int((w > 0).sum()))]] += 1
    return out


def shared_targets(sizes: Sequence[int], weights: Sequence[float], most_epochs: float) -> np.ndarray:
    """Shares of the total size by weight, none above ``most_epochs`` times its own size."""
    size, w = np.asarray(sizes, float), np.asarray(weights, float)
    target, full = np.zeros(len(size)), np.zeros(len(size), bool)
    cap = most_epochs * size
    while True:
        free = ~full
        left = size.sum() - cap[full].sum()
        target[full] = cap[full]
        if not free.any():
            return target
        target[free] = left * w[free] / w[free].sum()
        over = free & (target > cap)
        if not over.any():
            return target
        full |= over


def _draw(seed: int, *keys: Column) -> Column:
    """A number below 2^60 from the seed and the keys, the same in any SQL engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _order(name: str | None) -> tuple[bool, str]:
    return name is None, name or ""


def mix(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: Iterable[float] = (1, 2, 3), most_epochs: int = 3, block: int = 16, shard_docs: int = 1000, seed: int = 17,
    carry: list[str] | None = None,
) -> DataFrame:
    """All rows with ``size``, ``source_size``, ``target``, ``taken`` and the places of the words taken.

    ``passes`` whole copies are taken, and of one more copy the words
    [``from_word``, ``to_word``) and [0, ``wrapped``).  ``weights`` repeat over the
    sources in code point order.
    """
    spark = docs.sparkSession
    carry = [c for c in (carry or []) if c in others(docs, (*RESULT, *PLACES, doc_id))]
    names = {c: f"__c{i}" for i, c in enumerate(carry)}
    size = F.coalesce(F.regexp_count(quoted(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(quoted(doc_id).alias("__id"), quoted(source).cast("string").alias("__source"), size.alias("size"), F.monotonically_increasing_id().alias("__row"), *[quoted(c).alias(n) for c, n in names.items()])
    own = F.when(F.col("__id").isNull(), F.concat(F.lit("row "), F.col("__row").cast("string"))).otherwise(F.col("__id").cast("string"))
    rows = store(rows.withColumn("__order", _draw(seed, own, F.col("__source"), F.col("size"))), "sizes")
    facts = sorted(rows.groupBy("__source").agg(F.sum("size"), F.count(F.lit(1))).collect(), key=lambda r: _order(r[0]))
    cycle = list(weights)
    sizes = [int(r[1] or 0) for r in facts]
    targets = shared_targets(sizes, [cycle[k % len(cycle)] for k in range(len(facts))], most_epochs)
    seats = np.minimum(sainte_lague(targets, sum(sizes) // block), np.asarray(sizes, np.int64) * most_epochs // block)
    # a source smaller than one seat still takes what its target says
    words = [int(q) * block if q else min(int(round(t)), s * most_epochs) for q, t, s in zip(seats, targets, sizes, strict=True)]
    schema = "name string, src int, source_size long, target double, quota long, n_shards int"
    known = spark.createDataFrame([(r[0], k, s, float(t), q, max(1, -(-r[2] // shard_docs))) for k, (r, s, t, q) in enumerate(zip(facts, sizes, targets, words, strict=True))], schema)
    known = F.broadcast(known) if len(facts) <= BROADCAST_SOURCES else known
    placed = rows.join(known, rows["__source"].eqNullSafe(known["name"])).drop("name", "__source", "quota").withColumn("shard", (_draw(seed + 1, F.col("__order")) % F.col("n_shards")).cast("int")).drop("n_shards")
    quotas = _quotas(placed, known, block, most_epochs)
    cell = Window.partitionBy("src", "shard").orderBy("__order", "__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = placed.withColumn("__end", F.sum("size").over(cell)).join(grows(quotas), ["src", "shard"])
    zero = F.lit(0).cast("long")
    begin = F.col("__end") - F.col("size")
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("cell") / block))
    met = met.withColumns({
        "passes": F.when(F.col("cell") > 0, F.expr("words div cell")).otherwise(zero),
        "__rest": F.when(F.col("cell") > 0, F.expr("words % cell")).otherwise(zero),
        "__run": _draw(seed + 2, F.col("src"), F.col("shard")) % blocks * block,
    })

    def inside(a: Column, b: Column) -> Column:
        return F.greatest(zero, F.least(b, F.col("__end")) - F.greatest(a, begin))

    stop = F.col("__run") + F.col("__rest")
    met = met.withColumns({"__first": inside(F.col("__run"), F.least(stop, F.col("cell"))), "wrapped": inside(zero, stop - F.col("cell")), "from_word": F.greatest(zero, F.col("__run") - begin)})
    return met.select(
        F.col("__id").alias(doc_id), *[F.col(n).alias(c) for c, n in names.items()], "size", "source_size", "target",
        (F.col("passes") * F.col("size") + F.col("__first") + F.col("wrapped")).alias("taken"),
        "shard", "passes", "from_word", (F.col("from_word") + F.col("__first")).alias("to_word"), "wrapped",
    )


def _quotas(placed: DataFrame, known: DataFrame, block: int, most_epochs: int) -> DataFrame:
    """Words for each (source, shard): the seats with the highest quotients size / (2 k + 1) of all shards of the source, as many as each may have.

    Shards have min(most, round(size / d)) seats for a divisor d.  The divisor is bracketed
    for every source; below the upper end of the bracket the best quotients fill up."""
    cells = placed.groupBy("src", "shard").agg(F.sum("size").alias("cell")).join(known.select("src", "quota"), "src")
    cells = cells.withColumn("unit", F.when((F.col("quota") >= block) & (F.col("quota") % block == 0), block).otherwise(1).cast("long"))
    cells = store(cells.withColumns({"seats": F.expr("quota div unit"), "most": F.floor(F.col("cell") * most_epochs / F.col("unit")).cast("long")}), "cells")
    ends = store(cells.groupBy("src").agg(F.lit(1e-6).alias("low"), (F.max("cell") * 2.0 + 1).alias("high")), "divisors")

    def seats_at(d: Column) -> Column:
        return F.least(F.col("most"), F.floor(F.col("cell") / d + 0.5).cast("long"))

    for _ in range(ROUNDS):
        at = [F.col("low") * F.pow(F.col("high") / F.col("low"), F.lit(k / DIVISORS)) for k in range(DIVISORS + 1)]
        sums = cells.join(ends, "src").groupBy("src").agg(F.first("low").alias("low"), F.first("high").alias("high"), F.max("seats").alias("seats"), *[F.sum(seats_at(d)).alias(f"s{k}") for k, d in enumerate(at)])
        # the smallest divisor that gives no more than all seats, and the one below it
        step = F.coalesce(*[F.when(F.col(f"s{k}") <= F.col("seats"), k) for k in range(DIVISORS + 1)]).cast("int")
        grid = F.array(*at)
        ends = store(sums.select("src", F.element_at(grid, F.greatest(step, F.lit(1))).alias("low"), F.element_at(grid, step + 1).alias("high")), "divisors")
    shared = cells.join(ends, "src").withColumns({"sure": seats_at(F.col("high")), "wide": seats_at(F.col("low"))})
    shared = store(shared.drop("low", "high"), "sure-seats")
    left = shared.groupBy("src").agg((F.max("seats") - F.sum("sure")).alias("left"))
    offers = shared.filter("wide > sure").select("src", "shard", "cell", F.explode(F.expr("sequence(sure, wide - 1)")).alias("k"))
    ranked = offers.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy((F.col("cell") / (2 * F.col("k") + 1)).desc(), "shard"))).join(left, "src").filter("n <= left")
    more = ranked.groupBy("src", "shard").agg(F.count(F.lit(1)).alias("more"))
    return store(shared.join(grows(more), ["src", "shard"], "left").select("src", "shard", "cell", ((F.col("sure") + F.coalesce("more", F.lit(0))) * F.col("unit")).cast("long").alias("words")), "quotas")


def take(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", chars: str | None = "n_chars", **options) -> DataFrame:  # type: ignore[no-untyped-def]
    """The mix itself: ``docs`` with each row as often as it is taken; a part taken is a row with that part of the text."""
    columns = docs.columns
    clash = {c: f"__in_{c}" for c in columns if c.lower() in (*RESULT, *PLACES)}
    safe = docs.select(*[quoted(c).alias(clash.get(c, c)) for c in columns])
    taken = mix(safe, text, doc_id, source, carry=[clash.get(c, c) for c in columns if c != doc_id], **options)
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("b")), F.col("passes").cast("int"))
    parts = F.array(F.struct(F.col("from_word").alias("a"), F.col("to_word").alias("b")), F.struct(F.lit(0).cast("long").alias("a"), F.col("wrapped").alias("b")))
    runs = F.filter(F.concat(whole, parts), lambda r: r["b"] > r["a"])
    spread = taken.filter("taken > 0").withColumn("__run", F.explode(runs))
    cut = (F.col("__run.a") > 0) | (F.col("__run.b") < F.col("size"))
    out = spread.withColumns({"__text": F.when(cut, _words(quoted(text), F.col("__run.a"), F.col("__run.b"))).otherwise(quoted(text)), "__cut": cut})
    picked = {c: quoted(clash.get(c, c)) for c in columns} | {text: F.col("__text")}
    if chars in columns:
        picked[chars] = F.when(F.col("__cut"), F.length("__text")).otherwise(quoted(clash.get(chars, chars))).cast(docs.schema[chars].dataType)
    return out.select(*[picked[c].alias(c) for c in columns])


@F.pandas_udf(T.StringType())
def _words(texts, first, last):  # type: ignore[no-untyped-def]
    """Words [first, last) of each text with what stands between them."""
    import re

    import pandas as pd

    word = re.compile(WORD)

    def one(text: str, a: int, b: int) -> str | None:
        if text is None:
            return None
        begin = end = 0
        for k, m in enumerate(word.finditer(text)):
            if k == a:
                begin = m.start()
            if k == b - 1:
                end = m.end()
                break
        return text[begin:end]

    return pd.Series([one(t, a, b) for t, a, b in zip(texts, first, last, strict=True)], dtype=object)

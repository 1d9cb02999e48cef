"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by the next bytes of their UTF-8 text.  Every round takes one
radix digit (a run of bytes; digits widen from round to round) and counts documents
per (group, digit, text goes on).  A document alone in its cell is finished; a cell
whose texts have ended is a class of equal texts; all other cells form the groups of
the next round.  Equality is decided by the bytes themselves, never by a digest.

Scale: counting is a two-step hash aggregation with map-side combine, so a cell that
holds a third of all rows costs each reducer one row per map task.  Documents meet
their cell by an equi-join of two freshly exchanged sides, which adaptive execution
splits when a cell is hot.  Nothing is gathered per cell.  The state of a round is a
table in the shared folder, so lineage is cut and lost executors only cost a task.

Edge cases: null text is the empty text (all such rows are equal); a null id never
wins against a non-null one; if several rows share both text and winning id, exactly
one of them is kept; an empty table gives an empty result; input columns named like
a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, grows, others, quoted, store, utf8

RESULT = ("keep_id", "group_size", "kept", "text_sha256")
#: Width in bytes of the radix digit of each round; the last one repeats.
DIGITS = (512, 4096, 32768, 262144, 1 << 21)


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None, digits: tuple[int, ...] = DIGITS) -> DataFrame:
    """All rows of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``carry`` names the input columns to return besides ``doc_id`` (default: all).
    Runs one small job per radix round; the number of rounds is logarithmic in the
    length of the longest duplicated prefix.
    """
    carry = [c for c in (others(docs, RESULT) if carry is None else carry) if c != doc_id]
    names = {c: f"__c{i}" for i, c in enumerate(carry)}
    body = utf8(quoted(text))
    rows = docs.select(
        quoted(doc_id).alias("__id"),
        *[quoted(c).alias(n) for c, n in names.items()],
        F.sha2(body, 256).alias("text_sha256"),
        F.lit(0).cast("long").alias("__group"),
        body.alias("__rest"),
    )
    fixed = ["__id", *names.values(), "text_sha256"]
    finished: list[DataFrame] = []
    ties = False
    width, depth = digits[0], 0
    while True:
        digit = [F.col("__group"), F.substring("__rest", 1, width).alias("__digit"), (F.length("__rest") > width).alias("__more")]
        cells = Stored(_cells(rows.select("__id", *digit)), f"radix-cells-{depth}")
        keyed = rows.select(*fixed, *digit, F.when(F.length("__rest") > width, F.expr(f"substring(__rest, {width + 1}, length(__rest))")).alias("__tail"))
        met = keyed.alias("k").join(grows(cells.df.alias("c")), (F.col("k.__group") == F.col("c.__group")) & (F.col("k.__digit") == F.col("c.__digit")) & (F.col("k.__more") == F.col("c.__more")), "left")
        goes_on = F.col("c.n").isNotNull() & F.col("k.__more")
        state = store(
            met.select(
                *[F.col(f"k.{c}").alias(c) for c in fixed],
                F.col("c.next_group").alias("__group"), F.col("c.n").alias("__n"), F.col("c.keep").alias("__keep"), F.col("c.tied").alias("__tied"),
                goes_on.alias("__open"), F.when(goes_on, F.col("k.__tail")).alias("__rest"), F.monotonically_increasing_id().alias("__row"),
            ),
            f"radix-state-{depth}",
        )
        finished.append(state.filter(~F.col("__open")).withColumn("__round", F.lit(depth)).drop("__rest", "__open"))
        summary = cells.df.agg(F.max("__more"), F.max(~F.col("__more") & F.col("tied"))).first()
        cells.drop()
        ties = ties or bool(summary[1])
        if not summary[0]:
            break
        rows = state.filter("__open").select(*fixed, "__group", "__rest")
        depth += 1
        width = digits[min(depth, len(digits) - 1)]
    done = finished[0]
    for more in finished[1:]:
        done = done.unionByName(more)
    alone = F.col("__n").isNull()
    wins = alone | F.col("__id").eqNullSafe(F.col("__keep"))
    if ties:
        first = store(done.filter("__tied").filter(F.col("__id").eqNullSafe(F.col("__keep"))).groupBy("__round", "__group").agg(F.min("__row").alias("__first")), "radix-ties")
        done = done.join(grows(first), ["__round", "__group"], "left")
        wins = wins & (F.col("__first").isNull() | (F.col("__first") == F.col("__row")))
    return done.select(
        F.col("__id").alias(doc_id),
        *[F.col(n).alias(c) for c, n in names.items() if c not in RESULT],
        F.when(alone, F.col("__id")).otherwise(F.col("__keep")).alias("keep_id"),
        F.coalesce("__n", F.lit(1).cast("long")).alias("group_size"),
        wins.alias("kept"),
        "text_sha256",
    )


def _cells(keys: DataFrame) -> DataFrame:
    """Cells of two rows or more: size, largest id, whether several rows have that id, and a number for the next round."""
    cell = ["__group", "__digit", "__more"]
    return (
        keys.groupBy(*cell, "__id").agg(F.count(F.lit(1)).alias("c"))
        .groupBy(*cell).agg(F.sum("c").alias("n"), F.max("__id").alias("keep"), F.max_by("c", "__id").alias("top"))
        .filter("n > 1")
        .select(*cell, "n", "keep", F.when(F.col("keep").isNull(), F.col("n") > 1).otherwise(F.col("top") > 1).alias("tied"), F.monotonically_increasing_id().alias("next_group"))
    )


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class of equal texts, its columns unchanged."""
    columns = docs.columns
    clash = {c: f"__in_{c}" for c in columns if c.lower() in RESULT}
    safe = docs.select(*[quoted(c).alias(clash.get(c, c)) for c in columns])
    marked = exact_duplicates(safe, text, doc_id)
    return marked.filter("kept").select(*[quoted(clash.get(c, c)).alias(c) for c in columns])

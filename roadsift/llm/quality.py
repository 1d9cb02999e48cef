"""Quality rules: counts per document, and frequent lines per host.

Base rules look at one document (word counts, signs, repeated lines and windows).  The
corpus rule looks across documents: lines are normalised (ASCII lower case, runs of
white space as one space, trimmed) and hashed; for every host the documents that hold a
line are counted, equal texts once.  A line held by more than ``line_docs`` documents, and
by more than ``line_share`` of the host's documents or more than ``line_most`` documents
whatever the host's size, is boilerplate: it is removed, and a document that loses more
than ``depleted`` of its words is rejected.

Scale: one Arrow pass makes the counts and line hashes, kept as a table in the shared
folder.  Frequencies are two hash aggregations with map-side combine; the frequent lines,
few or many, meet the documents in an equi-join whose two sides are exchanged, which
adaptive execution splits where a line is hot.

Edge cases: null text has no words and fails the base rules; a null host is a host of
its own; repeated rows are judged once each; result columns win over carried columns of
the same name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import grows, hash_words, ids_field, others, quoted, slices, store, utf8, window_hashes

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULT = (*BASE, "base_failed", "n_frequent_words", "kept")
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
CONTINUED = bytes(range(0x80, 0xC0))
WINDOW = 8


def repeated_words(words: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in windows which occur twice or more."""
    marks = window_hashes(words, width)
    if len(marks) < 2:
        return 0
    order = np.argsort(marks, kind="stable")
    ranked = marks[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(marks), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:-1][: len(marks)] += twice
    cover[width:][: len(marks)] -= twice
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def normalised(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def line_hash(line: bytes) -> int:
    value = xxhash.xxh3_64_intdigest(line)
    return value - (1 << 64) if value >= 1 << 63 else value


def document_facts(body: bytes) -> tuple[list[int], list[int], list[int]]:
    """The base counts, the hashes of the distinct normalised lines, and the words of all occurrences of each."""
    words = body.split()
    symbols = len(body) - len(body.translate(None, SYMBOLS))
    points = len(body.translate(None, CONTINUED + SPACE))
    seen: set[bytes] = set()
    repeats = 0
    lines: dict[int, int] = {}
    for line in body.split(b"\n"):
        n = len(line.split())
        if n:
            if line in seen:
                repeats += 1
            seen.add(line)
            key = line_hash(normalised(line))
            lines[key] = lines.get(key, 0) + n
    base = [len(words), points, symbols, repeats, repeated_words(hash_words(words)) if len(words) > WINDOW else 0]
    return base, list(lines), list(lines.values())


def judge(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", line_docs: int = 20, line_share: float = 0.05, line_most: int = 10_000, depleted: float = 0.5,
    min_words: int = 20, max_repeat: int = 30, carry: list[str] | None = None, clean: bool = False,
) -> DataFrame:
    """All rows with the counts, ``base_failed``, ``n_frequent_words`` and ``kept``.

    ``carry`` names input columns to return besides ``doc_id`` (default none).  With
    ``clean`` the text column is carried too, without the frequent lines.
    """
    carry = [c for c in (carry or []) if c in others(docs, (*RESULT, doc_id, text))]
    names = {c: f"__c{i}" for i, c in enumerate(carry)}
    rows = docs.select(
        quoted(doc_id).alias("__id"), quoted(host).cast("string").alias("__host"), utf8(quoted(text)).alias("__body"),
        quoted(text).isNull().alias("__null"), *[quoted(c).alias(n) for c, n in names.items()],
    )
    kept_columns = ["__id", "__host", *names.values(), *(["__body", "__null"] if clean else [])]
    types = {c: ids_field(rows, c) for c in kept_columns}
    schema = T.StructType([rows.schema[c] for c in kept_columns] + [T.StructField(c, T.LongType()) for c in (*BASE, "__text")] + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("__lines", "__words")])

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__body", 2000, 8 << 20):
            bodies = batch.column("__body").to_pylist()
            found = [document_facts(b) for b in bodies]
            columns = [batch.column(c).cast(types[c]) for c in kept_columns]
            columns += [pa.array([f[0][k] for f in found], pa.int64()) for k in range(len(BASE))]
            columns += [pa.array([line_hash(b) for b in bodies], pa.int64())]
            columns += [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    table = store(rows.mapInArrow(facts, schema).withColumn("__row", F.monotonically_increasing_id()), "line-facts")
    # documents of equal text count once on a host
    lines = table.select("__host", "__text", F.explode("__lines").alias("line"))
    totals = table.select("__host", "__text").distinct().groupBy("__host").agg(F.count(F.lit(1)).alias("docs"))
    often = lines.distinct().groupBy("__host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > line_docs)
    limit = F.least(F.lit(float(line_most)), F.greatest(F.lit(float(line_docs)), F.col("docs") * F.lit(line_share)))
    frequent = store(often.join(totals, often["__host"].eqNullSafe(totals["__host"])).filter(F.col("n") > limit).select(often["__host"].alias("host"), F.col("line").alias("frequent")), "frequent-lines")
    spread = table.select("__row", "__host", F.explode(F.arrays_zip(F.col("__lines").alias("line"), F.col("__words").alias("words"))).alias("at")).select("__row", "__host", F.col("at.line").alias("line"), F.col("at.words").alias("words"))
    hits = spread.join(grows(frequent), spread["__host"].eqNullSafe(frequent["host"]) & (spread["line"] == frequent["frequent"]))
    lost = store(hits.groupBy("__row").agg(F.sum("words").alias("n_frequent_words"), *([F.collect_set("line").alias("__cut")] if clean else [])), "lost-lines")
    judged = table.join(grows(lost), "__row", "left").withColumn("n_frequent_words", F.coalesce("n_frequent_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    judged = judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("n_frequent_words") <= F.col("n_words") * F.lit(depleted)))
    out = [F.col("__id").alias(doc_id), *[F.col(n).alias(c) for c, n in names.items()]]
    if clean:
        whole = F.when(F.col("__null"), F.lit(None)).otherwise(F.col("__body").cast("string"))
        out.append(F.when(F.col("n_frequent_words") > 0, _without(F.col("__body"), F.col("__cut"))).otherwise(whole).alias(text))
    return judged.select(*out, *RESULT)


@F.pandas_udf(T.StringType())
def _without(bodies, cuts):  # type: ignore[no-untyped-def]
    """Texts without the lines whose hashes are given."""
    import pandas as pd

    def one(body: bytes, cut: np.ndarray | None) -> str:
        if cut is None:
            return body.decode()
        gone = set(map(int, cut))
        return b"\n".join(x for x in body.split(b"\n") if not x.split() or line_hash(normalised(x)) not in gone).decode()

    return pd.Series([one(b, c) for b, c in zip(bodies, cuts, strict=True)], dtype=object)


def keep_good(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", chars: str | None = "n_chars", **limits: float) -> DataFrame:
    """``docs`` without the rejected rows; kept texts lose their frequent lines, ``chars`` is their new length."""
    columns = docs.columns
    clash = {c: f"__in_{c}" for c in columns if c.lower() in RESULT}
    safe = docs.select(*[quoted(c).alias(clash.get(c, c)) for c in columns])
    good = judge(safe, text, doc_id, host, carry=[clash.get(c, c) for c in columns], clean=True, **limits).filter("kept")
    if chars in columns:
        length = F.when(F.col("n_frequent_words") > 0, F.length(quoted(text))).otherwise(quoted(chars))
        good = good.withColumn(chars, length.cast(docs.schema[chars].dataType))
    return good.select(*[quoted(clash.get(c, c)).alias(c) for c in columns])

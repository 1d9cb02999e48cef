"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roadsift.llm import exact_dedup, html_extract, langid, licenses, line_dedup, mixing, near_dup, packing, quality, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Kept string, Size string, __row string"
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud".split()


def prose(k: int, n: int = 60) -> str:
    return " ".join(WORDS[(k * 7 + i * (k + 3) + i * i) % len(WORDS)] + str(i % (k + 5)) for i in range(n))


ROWS = [
    (1, prose(1), "en", "a", 1, "x", "y", "z"),
    (2, prose(1), "en", "b", 1, "x", "y", "z"),
    (2, prose(1), "en", "b", 1, "x", "y", "z"),
    (3, prose(2), None, None, None, None, None, None),
    (None, prose(3), "de", "a", 1, "x", "y", "z"),
    (None, None, None, None, None, None, None, None),
    (4, None, "en", "a", 1, "x", "y", "z"),
    (5, "", "en", "a", 0, "x", "y", "z"),
    (6, " \n\t ", "en", "a", 0, "x", "y", "z"),
    (7, "Kurz.", "de", "b", 5, "x", "y", "z"),
    (8, "Kurz.", "de", "b", 5, "x", "y", "z"),
    (9, prose(4, 9000), "en", "b", 5, "x", "y", "z"),
    (10, prose(4, 9000), "en", "c", 5, "x", "y", "z"),
    (10, prose(5), "en", "c", 5, "x", "y", "z"),
    (11, prose(6) + "\n" + prose(6) + "\n\x00 é 😀 <|endoftext|>", "fr", "c", 5, "x", "y", "z"),
]

RUNS = {
    "exact": lambda d: exact_dedup.exact_duplicates(d),
    "exact_drop": lambda d: exact_dedup.drop_exact_duplicates(d),
    "pack": lambda d: packing.pack_documents(d),
    "lines": lambda d: line_dedup.dedup_lines(d, carry=d.columns),
    "shard": lambda d: sharding.shard(d, limit=2000, carry=d.columns),
    "quality": lambda d: quality.judge(d, carry=d.columns),
    "quality_keep": lambda d: quality.keep_good(d),
    "mix": lambda d: mixing.mix(d, carry=d.columns),
    "take": lambda d: mixing.take(d),
    "near": lambda d: near_dup.near_duplicates(d),
    "near_carry": lambda d: near_dup.near_duplicates(d, carry=d.columns),
    "near_drop": lambda d: near_dup.drop_near_duplicates(d),
    "license": lambda d: licenses.scan_licenses(d, carry=d.columns),
    "lang": lambda d: langid.predict(d, langid.fit(d, d["doc_id"] > 0, sample=10, windows=20, epochs=1), carry=d.columns),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", [n for n in RUNS if n not in ("exact_drop", "pack", "quality_keep", "take", "near_drop")])
def test_one_row_a_document(docs, name):
    out = RUNS[name](docs)
    key = lambda v: (v is None, v or 0)
    assert sorted((r["doc_id"] for r in out.collect()), key=key) == sorted((r[0] for r in ROWS), key=key)


def test_exact_classes(docs):
    rows = exact_dedup.exact_duplicates(docs, carry=["text"]).collect()
    texts = [r[1] or "" for r in ROWS]
    assert len(rows) == len(ROWS)
    for text in set(texts):
        own = [r for r in rows if (r["text"] or "") == text]
        assert len(own) == texts.count(text) == own[0]["group_size"]
        assert {r["keep_id"] for r in own} == {max((r[0] for r in ROWS if (r[1] or "") == text and r[0] is not None), default=None)}
        assert sum(r["kept"] for r in own) == 1
        assert {r["text_sha256"] for r in own} == {hashlib.sha256(text.encode()).hexdigest()}


def test_exact_digits_split_like_any_others(docs):
    whole = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(docs, carry=[]).collect()}
    assert whole == {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(docs, carry=[], digits=(3, 50, 9000)).collect()}


def test_dropping_keeps_columns(docs):
    for name in ("exact_drop", "quality_keep", "take", "near_drop"):
        assert RUNS[name](docs).columns == docs.columns, name
    assert exact_dedup.drop_exact_duplicates(docs).count() == len({r[1] or "" for r in ROWS})


def test_near_drop(docs):
    rows = near_dup.drop_near_duplicates(docs).collect()
    # no links for the four texts without words; equal texts are linked
    assert len(rows) == 4 + len({r[1] for r in ROWS if r[1] and r[1].split()})


def test_near_carry_loses_no_row(docs):
    rows = near_dup.near_duplicates(docs, carry=["text", "Kept", "source"]).collect()
    assert [f for f in rows[0].asDict()] == ["doc_id", "n_shingles", "component_id", "kept", "text", "source"]
    assert sorted((r["text"] or "", r["doc_id"] or -1) for r in rows) == sorted((r[1] or "", r[0] or -1) for r in ROWS)
    plain = near_dup.near_duplicates(docs).collect()
    key = lambda r: (r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"])
    assert sorted(map(key, rows)) == sorted(map(key, plain))


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    from roadsift.llm.tokens import vocabulary_path

    tok = Tokenizer.from_file(vocabulary_path())
    import numpy as np

    rows = packing.pack_documents(docs, size=256, segments=3).collect()
    ids = sorted(zlib.crc32(np.asarray([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in ROWS)
    assert sum(r["length"] for r in rows) == sum(len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ROWS)
    for doc in {r[0] for r in ROWS if [x[0] for x in ROWS].count(r[0]) == 1}:
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        text = next(r[1] for r in ROWS if r[0] == doc)
        whole = np.asarray([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(whole)
            assert r["ids_crc32"] == zlib.crc32(whole[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(whole)
    assert ids
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) <= 256 and len(own) <= 3


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>Tail &amp; all"), (4, "u", "<article><p>a<p>b &lt;c&gt;<script>x</script></article><nav><a>m</a></nav>"), (4, "u", "<article><p>a</article>")], "page_id long, url string, html string")
    rows = html_extract.extract_pages(pages).collect()
    assert sorted(r["text"] for r in rows) == ["", "", "Tail & all", "a", "a b <c>"]
    assert html_extract.extract_pages(pages.limit(0)).collect() == []


def test_html_long_repeated_and_clashing_pages(spark):
    article = "<article><p>" + "word after word of a very long page " * 40_000 + "</p></article>"
    pages = spark.createDataFrame([(k, "u", article, "mine", 5, "x") for k in (1, 2, 2)], "page_id long, url string, html string, text string, N_chars long, `a b` string")
    rows = html_extract.extract_pages(pages, carry=pages.columns).collect()
    assert [r["page_id"] for r in rows] == [1, 2, 2] and {r["n_chars"] for r in rows} == {len("word after word of a very long page ") * 40_000 - 1}
    assert all(r["text"].startswith("word after") and r["a b"] == "x" and r["html"] == article for r in rows)


def test_pipeline_on_edges(spark, tmp_path):
    d = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4]) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    d.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_language_sample_does_not_rest_on_ids(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "train", lambda texts, labels, **_: seen.update(texts=texts, labels=labels))
    base = spark.range(4000).select(F.concat_ws(" ", F.lit("word"), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 2 == 0, F.lit("aa")).otherwise(F.lit("bb")).alias("lang"))
    for ids in (F.lit(None).cast("long"), F.lit(7).cast("long")):
        langid.fit(base.withColumn("doc_id", ids), F.lit(True), sample=50)
        assert all(25 <= seen["labels"].count(lang) <= 85 for lang in ("aa", "bb"))
    copies = base.withColumn("text", F.lit("the same text"))
    langid.fit(copies.withColumn("doc_id", F.lit(None).cast("long")), F.lit(True), sample=50)
    assert sorted(seen["labels"]) == ["aa", "bb"]
    long = spark.createDataFrame([(1, "".join(chr(97 + k // 256 % 26) for k in range(256 * 1000)), "aa")], "doc_id long, text string, lang string")
    langid.fit(long, F.lit(True), longest=10)
    assert [len(t) for t in seen["texts"]] == [2560] and {t[k * 256 : (k + 1) * 256] for t in seen["texts"] for k in range(10)} == {bytes([97 + k * 100 % 26]) * 256 for k in range(10)}
    langid.fit(long, F.lit(True), longest=1000)
    assert [len(t) for t in seen["texts"]] == [256_000]

"""Decontamination, hard negatives and ranked search against brute force, with nulls, ties, repeats and hot groups."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadsift.llm import decontaminate, hard_negatives, queries, tiered_search
from roadsift.llm.words import flat_words

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
VOCAB = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu".split() for b in "lan ter son mir dak vel pon sik".split()]


def words_of(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def test_words_of_a_batch_stay_in_their_text():
    texts = ["Ab", "", "cD9 é-Ü x", "\x00", "tail", "one two", "!", "a　b"]
    for cut in range(len(texts)):
        words, bounds = flat_words(pa.array([t.encode() for t in texts], pa.binary()).slice(cut))
        flat = words.to_pylist()
        assert [flat[bounds[k] : bounds[k + 1]] for k in range(len(texts) - cut)] == [words_of(t) for t in texts[cut:]]
    assert len(flat_words(pa.array([], pa.binary()))[0]) == 0


# ---- decontamination ------------------------------------------------------------------------
def brute_overlap(text, items, window=10):
    own = words_of(text)
    hit, ids = set(), set()
    for item, item_text in items:
        parts = words_of(item_text)
        n = min(window, len(parts))
        grams = {tuple(parts[k : k + n]) for k in range(len(parts) - n + 1)} if n else set()
        for p in range(len(own) - n + 1) if n else ():
            if tuple(own[p : p + n]) in grams:
                hit |= set(range(p, p + n))
                ids.add(item)
    return len(own), len(hit), sorted(str(i) for i in ids if i is not None)


def contaminated_corpus(seed=1):
    rng = random.Random(seed)
    prose = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    items = [(k, " ".join(prose(rng.choice([12, 25, 40])))) for k in range(20)]
    items += [(20, " ".join(prose(3)) + "!"), (21, "Solo-word77"), (22, ""), (23, None), (None, " ".join(prose(15))), (5, " ".join(prose(14))), (24, "the " * 40), (25, items[3][1] + " more"), (26, " ".join(prose(9)))]
    texts = ["", None, "!?", "solo WORD77 solo word77", "the " * 300, "the " * 9]
    for k in range(60):
        body = prose(rng.randrange(5, 80))
        item = words_of(items[rng.randrange(len(items))][1])
        start = rng.randrange(max(1, len(item) - 9))
        part = [w.decode() for w in item[start : start + rng.choice([8, 9, 10, 11, 30])]]
        at = rng.randrange(len(body) + 1)
        texts.append((" " if k % 2 else ", ").join(w.upper() if k % 3 else w for w in body[:at] + part + body[at:]))
    texts += [texts[10], " ".join(t or "" for t in texts)]
    return items, texts


@pytest.mark.parametrize("gram", [5, 3, 10])
def test_overlap_equals_brute_force(spark, gram):
    items, texts = contaminated_corpus()
    docs = spark.createDataFrame([(k if k % 9 else None, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, N_WORDS string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.overlap(docs.withColumn("again", F.col("text")), bench, carry=["again", "doc_id", "N_WORDS"], gram=gram)
    assert got.columns == ["again", "doc_id", *decontaminate.RESULT]
    rows = got.collect()
    assert Counter(r["again"] for r in rows) == Counter(texts)
    for r in rows:
        n, hit, ids = brute_overlap(r["again"], items)
        assert (r["n_words"], r["n_hit"], r["item_ids"], r["n_items"], r["contaminated"]) == (n, hit, ids, len(ids), hit > 0)
        covered = [p for s in r["spans"] for p in range(s["start"], s["stop"])]
        assert len(covered) == len(set(covered)) == hit and covered == sorted(covered)


def test_overlap_with_a_full_bitmap_and_without_items(spark, monkeypatch):
    """A bitmap too small for its fingerprints lets everything through; the join still decides."""
    items, texts = contaminated_corpus(2)
    monkeypatch.setattr(decontaminate, "BITS", (6, 6))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.overlap(docs, bench, carry=["doc_id"]).collect()}
    for k, t in enumerate(texts):
        assert (got[k]["n_words"], got[k]["n_hit"], got[k]["item_ids"]) == brute_overlap(t, items)
    none = decontaminate.overlap(docs, bench.filter("item_id < 0")).collect()
    assert len(none) == len(texts) and not any(r["contaminated"] or r["spans"] or r["item_ids"] for r in none)
    assert decontaminate.overlap(docs.filter("doc_id < 0"), bench).count() == 0


def test_hot_passage_and_removal(spark):
    rng = random.Random(3)
    passage = " ".join(rng.choice(VOCAB) for _ in range(30))
    texts = [(passage if k % 3 == 0 else "") + " " + " ".join(rng.choice(VOCAB) + str(rng.randrange(99)) for _ in range(20)) for k in range(600)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(5)
    bench = spark.createDataFrame([(k, f"item{k} {passage}") for k in range(40)], "item_id long, text string")
    rows = decontaminate.overlap(docs, bench).collect()
    assert all(r["n_items"] == (40 if r["doc_id"] % 3 == 0 else 0) and r["n_hit"] == (30 if r["doc_id"] % 3 == 0 else 0) for r in rows)
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {k for k in range(600) if k % 3}
    assert decontaminate.drop_contaminated(docs, bench, most_share=0.9).count() == 600


def test_same_words_in_thue_morse_order_are_told_apart(spark):
    """Windows are compared by their words, whatever their hashes."""
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    a, b = (" ".join(("alpha", "omega")[x ^ flip] for x in bits) for flip in (0, 1))
    docs = spark.createDataFrame([(1, "q " + a), (2, "q " + b)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontaminate.overlap(docs, bench, window=1024, gram=1024).collect()}
    assert got == {1: (1025, 1024), 2: (1025, 0)}


def test_query_digest(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, "a b c d e f g h i j"), (9, "b c d e f g h i j k")], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in queries.op11_decontamination(spark, str(tmp_path)).collect()}
    assert got[1]["items_sha256"] == hashlib.sha256(b"10,9").hexdigest() and got[1]["n_hit"] == 11 and got[1]["n_items"] == 2
    assert got[2]["items_sha256"] == hashlib.sha256(b"").hexdigest() and not got[2]["contaminated"]


# ---- hard negatives -------------------------------------------------------------------------
def brute_negatives(rows, positives=5, negatives=10, low=30, high=90):
    taken = []
    for k, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        taken.append((k, i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    last = lambda i: (i is None, i or 0)
    out = []
    for k, i, q, label in taken:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(q, p, strict=False)), j, n, lab) for n, j, p, lab in taken if n != k]
        scored.sort(key=lambda s: (-s[0], last(s[1]), s[2]))
        for top in [s for s in scored if s[3] == label][:positives]:
            window = [s for s in scored if s[3] != label and low * top[0] <= 100 * s[0] <= high * top[0]]
            out += [(i, top[1], rank, s[1], top[0], s[0]) for rank, s in enumerate(window[:negatives], 1)]
    return Counter(out)


def vector_rows(seed=0, n=900, width=8, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = []
    for k in range(n):
        own = 0 if k % 3 == 0 else rng.integers(6)  # a third of all rows around one centre
        v = centres[own] + rng.normal(size=width) * 0.3
        rows.append((k, [float(np.float32(x)) for x in v * scale], int(own + (k % 5 == 0))))
    same = rows[30][1]
    rows += [(1000 + k, same, 2 + k % 2) for k in range(60)]  # equal vectors
    rows += [(100, rows[100][1], 1), (None, same, 2), (2000, None, 1), (2100, same, None), (2200, [1.0, None] + [0.0] * (width - 2), 1), (2300, [float("nan")] * width, 1), (2400, [float("inf")] + [0.0] * (width - 1), 2)]
    rows += [(2500, [0.0] * width, 3), (2600, [1.0], 1), (2700, [0.5] * width, 77)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, Rank string"


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)
    out = hard_negatives.mine(df, anchor=F.col("vec_id") % 100 == 0, flip=F.col("vec_id") % 7 == 0, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r) for r in out.collect())


@pytest.mark.parametrize("options", [{}, {"pivots": 12, "group": 2, "block": 100}, {"pivots": 5, "group": 1, "block": 5000, "positives": 2, "negatives": 3}])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, options):
    monkeypatch.setattr(hard_negatives, "ROWS_A_PIVOT", 10)
    rows = vector_rows()
    shape = {k: v for k, v in options.items() if k in ("positives", "negatives")}
    want = brute_negatives(rows, **shape)
    got = mined(spark, rows, **options)
    assert sum(want.values()) > 50
    scores = lambda c: Counter((a, r, p, s) for (a, _, r, _, p, s), n in c.items() for _ in range(n))
    assert scores(got) == scores(want) and got == want


def test_bounds_keep_rows_from_groups_they_cannot_serve(spark, monkeypatch):
    """Far-apart clusters: most rows go to few groups, and the result is still that of brute force."""
    monkeypatch.setattr(hard_negatives, "ROWS_A_PIVOT", 10)
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in np.eye(6)[k % 6] * 4 + rng.normal(size=6) * 0.05], k % 6 // 2 * 2 + (k % 50 == 0)) for k in range(1200)]
    served = []
    real = hard_negatives._met
    monkeypatch.setattr(hard_negatives, "_met", lambda s, a, *rest: served.append((s.count(), a.select("grp").distinct().count())) or real(s, a, *rest))
    got = mined(spark, rows, pivots=24, group=1)
    assert got == brute_negatives(rows)
    for met, groups in served:
        assert groups >= 6 and met < 0.6 * len(rows) * groups


def test_hard_negatives_of_nothing_and_of_large_components(spark):
    assert mined(spark, []) == Counter()
    assert mined(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 0.0], 2)]) == Counter()
    assert mined(spark, [(100, [1.0, 2.0], 1)]) == Counter()
    big = [(k * 50, [3e5 * (1 + k % 3), 2e5 * (k % 5)], k % 2) for k in range(40)]  # products beyond 2^53
    assert mined(spark, big) == brute_negatives(big)
    with pytest.raises(ValueError, match="too large"):
        mined(spark, [(100, [1e12, 1.0], 1), (101, [1.0, 1.0], 1)])


# ---- ranked search --------------------------------------------------------------------------
def brute_search(docs, items, k=50):
    bags = [(i, Counter(words_of(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags]
    n_docs, total = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for row, (i, bag, n) in enumerate(bags):
            score = 0
            for t in set(words_of(text)):
                if t in bag:
                    m = 100 - 50 + (50 * n * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, row, i))
        out += [(item, rank, s[4], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def search_corpus(seed=0, n=400):
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(8)]
    docs = []
    for k in range(n):
        body = [rng.choice(common) for _ in range(rng.randrange(5, 60))] + [rng.choice(VOCAB) for _ in range(rng.randrange(1, 12))]
        if k % 40 == 0:
            body += ["rare"] * rng.randrange(1, 5) + [f"only{k}"]
        rng.shuffle(body)
        docs.append((k, " ".join(body)))
    docs += [(k, docs[7][1]) for k in (500, 501, 3)] + [(None, docs[7][1]), (600, None), (601, ""), (602, "--"), (603, "C1 c1! c1-é"), (604, "rare")]
    items = [(0, "rare only40"), (1, "rare"), (2, "c1 c2 c3 " + " ".join(VOCAB[:5])), (3, docs[7][1]), (4, None), (5, "?"), (6, "unknown words here"), (None, "É c1"), (3, docs[7][1]), (7, " ".join(common)), (8, "only80 c1"), (9, VOCAB[3])]
    return docs, items


def searched(spark, docs, items, k=50, **options):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, Item_Id string, rank int").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    return tiered_search.search(d, i, k, **options)


@pytest.mark.parametrize("tiers", [(1_000, 50_000), (3, 20), (12, 60), (0, 0), (30, 200)])
@pytest.mark.parametrize("k", [50, 4])
def test_search_equals_brute_force(spark, monkeypatch, tiers, k):
    monkeypatch.setattr(tiered_search, "TIERS", tiers)
    docs, items = search_corpus()
    got = searched(spark, docs, items, k).collect()
    assert Counter(tuple(r)[:4] for r in got) == brute_search(docs, items, k)


def test_items_end_in_the_tier_that_proves_them(spark, monkeypatch):
    """Rare terms are proven by their first tier; common ones fall through; both are exact."""
    monkeypatch.setattr(tiered_search, "TIERS", (15, 100))
    docs, items = search_corpus(3)
    got = searched(spark, docs, items, 5).collect()
    assert Counter(tuple(r)[:4] for r in got) == brute_search(docs, items, 5)
    tiers = {r["item_id"]: r["tiers"] for r in got}
    assert tiers[1] == 1 and tiers[0] == 1 and tiers[7] == 3
    assert len(set(tiers.values())) >= 2


def test_search_in_blocks_of_items_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(tiered_search, "CELLS", 40)
    monkeypatch.setattr(tiered_search, "TIERS", (10, 50))
    docs, items = search_corpus(4)
    got = searched(spark, docs, items, 7, block_terms=10).collect()
    assert Counter(tuple(r)[:4] for r in got) == brute_search(docs, items, 7)


def test_search_of_nothing(spark):
    docs, items = search_corpus()
    assert searched(spark, [], items).count() == 0
    assert searched(spark, docs, []).count() == 0
    assert searched(spark, [(1, None), (2, "!")], items).count() == 0
    assert searched(spark, docs, [(1, None)]).count() == 0
    with pytest.raises(TypeError, match="integer"):
        tiered_search.search(spark.createDataFrame([("a", "b")], "doc_id string, text string"), spark.createDataFrame([(1, "b")], "item_id long, text string"))

"""Hot keys: a third of all rows in one group of copies, one line, one source."""

from __future__ import annotations

import random
from collections import Counter

from roadsift.llm import exact_dedup, line_dedup, mixing, near_dup, quality

WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu".split() for b in "lan ter son mir dak".split()]


def rows(n=900, seed=0):
    rng = random.Random(seed)
    hot = " ".join(rng.choice(WORDS) for _ in range(60))
    near = [rng.choice(WORDS) for _ in range(80)]
    out = []
    for k in range(n):
        if k % 3 == 0:
            text = hot
        elif k % 3 == 1:
            own = list(near)
            own[rng.randrange(80)] = f"w{k}"
            text = " ".join(own)
        else:
            text = " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(40)) + "\nthe same line stands below very many documents"
        out.append((k, text, "en", "a" if k % 3 else "b", len(text)))
    return out


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_hot_groups_stay_whole(spark):
    data = rows()
    df = spark.createDataFrame(data, COLUMNS).repartition(7)
    exact = exact_dedup.exact_duplicates(df, carry=[]).collect()
    sizes = Counter(r[1] for r in data)
    text = {r[0]: r[1] for r in data}
    assert len(exact) == len(data) and all(r["group_size"] == sizes[text[r["doc_id"]]] for r in exact)
    assert sum(r["kept"] for r in exact) == len(sizes)
    near = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df).collect()}
    assert {near[k] for k in range(0, 900, 3)} == {0} and {near[k] for k in range(1, 900, 3)} == {1}
    assert all(near[k] == k for k in range(2, 900, 3))


def test_hot_line_and_source(spark):
    data = rows()
    df = spark.createDataFrame(data, COLUMNS).repartition(7)
    judged = quality.judge(df).collect()
    assert len(judged) == len(data) and all(r["kept"] for r in judged)
    assert all(r["n_frequent_words"] == (8 if r["doc_id"] % 3 == 2 else 0) for r in judged)
    lines = line_dedup.dedup_lines(df).collect()
    assert sum(r["n_dropped"] for r in lines if r["doc_id"] % 3 == 2) == 299
    mixed = mixing.mix(df, shard_docs=50).collect()
    by = Counter()
    for r in mixed:
        by[r["target"]] += r["taken"]
    assert len(by) == 2 and all(abs(t - n) <= 16 * 20 for t, n in by.items())

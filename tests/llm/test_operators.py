"""Operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import html
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from unittest import mock

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from roadsift.llm import components, html_extract, langid, licenses, line_dedup, mixing, near_dup, packing, quality, queries, sharding
from roadsift.llm.components import connected_components

DATA = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
VOCAB = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu".split() for b in "lan ter son mir dak vel pon sik".split()]


@pytest.fixture(scope="module")
def rows():
    return pq.read_table(f"{DATA}/documents.parquet").to_pylist()


# ---- near duplicates ------------------------------------------------------------------------
def brute_shingles(text):
    words = WORD.findall(text.encode().lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_groups(texts):
    sets, label = [brute_shingles(t or "") for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    return [len(s) for s in sets], label


def near_texts(seed=0):
    rng = random.Random(seed)
    base = [[rng.choice(VOCAB) for _ in range(n)] for n in (40, 80, 120)]
    out = []
    for words in base:  # copies with some words changed, around the threshold, in chains
        current = list(words)
        for k in range(45):
            own = list(words if k % 3 else current)
            for _ in range(rng.randrange(0, max(2, len(own) // 30) + 1)):
                own[rng.randrange(len(own))] = rng.choice(VOCAB)
            current = own
            out.append(" ".join(own))
    passage = [rng.choice(VOCAB) for _ in range(60)]  # texts that share a passage but are not near
    out += [" ".join(passage + [rng.choice(VOCAB) for _ in range(40)]) for _ in range(40)]
    out += ["", None, " \n", "one", "ONE", "one two three four", out[3], out[3].upper(), out[50].replace(" ", "\n")]
    return out


def test_near_duplicates_equal_brute_force(spark):
    texts = near_texts()
    sizes, label = brute_groups(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = near_dup.near_duplicates(df).orderBy("doc_id").collect()
    assert [r["n_shingles"] for r in got] == sizes
    assert [r["component_id"] for r in got] == label
    assert [r["kept"] for r in got] == [i == g for i, g in enumerate(label)]


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """Sketch blocks of three classes and one partner at a time give the same groups."""
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    texts = near_texts(1)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r["component_id"] for r in near_dup.near_duplicates(df).orderBy("doc_id").collect()] == brute_groups(texts)[1]


def test_super_minhash(rows):
    rng = np.random.default_rng(0)
    for n, shared in ((300, 240), (1500, 1200), (20, 16), (1, 1)):
        a, b = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64), None
        x, y = np.sort(a[:n]), np.sort(a[n - shared :])
        s = near_dup.super_minhash(np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]), 2)
        assert abs((s[0] == s[1]).mean() - shared / (2 * n - shared)) < 0.15 and b is None
        assert (s >> np.uint64(48)).max() < 128 and (s != near_dup.UNSET).all()
    # early stopping changes nothing: a full walk of every element gives the same minima
    e = rng.integers(0, 2**63, 40, dtype=np.uint64)
    full = np.full(128, near_dup.UNSET)
    for x in e:
        walk, steps = list(range(128)), np.arange(129, dtype=np.uint64) * near_dup.GOLDEN
        for j in range(128):
            d = near_dup.mix64(np.asarray([x]) + steps[j + 1])[0]
            k = j + int(((int(d) & 0xFFFF) * (128 - j)) >> 16)
            walk[j], walk[k] = walk[k], walk[j]
            full[walk[j]] = min(full[walk[j]], (np.uint64(j) << np.uint64(48)) | (d >> np.uint64(16)))
    assert (near_dup.super_minhash(np.sort(e), np.zeros(40, np.int64), 1)[0] == full).all()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
def test_components(spark, pairs):
    label = {x: x for p in pairs for x in p}
    for a, b in pairs:
        x, y = label[a], label[b]
        label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    for tail in (components.TAIL, 10, -1):  # the first pass ends the work, the last few edges do, or rounds go on to the end
        with mock.patch.object(components, "TAIL", tail):
            got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert set(got) == set(label)
        assert {frozenset(k for k in got if got[k] == c) for c in got.values()} == {frozenset(k for k in label if label[k] == c) for c in label.values()}


# ---- fuzzy lines ----------------------------------------------------------------------------
def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.text("abcé ", max_size=18), st.text("abcé ", max_size=18), st.sampled_from([0.5, 0.8, 0.9]))
def test_edit_similarity(a, b, least):
    longest = max(len(a), len(b))
    want = levenshtein(a, b) <= int((1 - least) * longest + 1e-9)
    assert line_dedup.edit_similarity(a, b, least) == want


def line_docs():
    rng = random.Random(4)
    long = [rng.choice(VOCAB) for _ in range(220)]
    docs = []
    for k in range(30):
        own = list(long)
        if k % 2:
            own[rng.randrange(220)] = rng.choice(VOCAB)
        lines = [" ".join(own), " ".join(rng.choice(VOCAB) for _ in range(12)), f"Copyright {2000 + k}, all rights reserved by us.", "short", ""]
        rng.shuffle(lines)
        docs.append((k, "\n".join(lines)))
    return [*docs, (30, None), (None, docs[0][1]), (31, docs[1][1] + "\n" + docs[1][1])]


def similar_lines(nodes, least=0.9):
    """Pairs of distinct normalised lines by edit similarity alone."""
    out = []
    for a, b in itertools.combinations(sorted(nodes, key=len), 2):
        if len(a) >= least * len(b) - 1e-9 and line_dedup.edit_similarity(a.decode(), b.decode(), least):
            out.append((a, b))
    return out


def merged_lines(docs, links, min_words=1):
    """Brute force: texts without all occurrences but the first of each group of linked lines."""
    occurrences = []
    for row, (doc, text) in enumerate(docs):
        for pos, line in enumerate((text or "").encode().split(b"\n")):
            n = line_dedup.normalised(line)
            if n and n.count(b" ") + 1 >= min_words:
                occurrences.append(((doc is None, doc or 0, pos, row), n))
    label = {n: n for _, n in occurrences}
    for a, b in links:
        x, y = label[a], label[b]
        label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    first = {}
    for place, n in sorted(occurrences):
        first.setdefault(label[n], place)
    gone = {place for place, n in occurrences if first[label[n]] != place}
    return [(doc, "\n".join(x for p, x in enumerate((text or "").split("\n")) if (doc is None, doc or 0, p, row) not in gone)) for row, (doc, text) in enumerate(docs)]


@pytest.mark.parametrize("min_words", [1, 4])
def test_line_dedup_equals_brute_force(spark, min_words):
    docs = line_docs()
    nodes = {n for _, t in docs for line in (t or "").encode().split(b"\n") if (n := line_dedup.normalised(line)) and n.count(b" ") + 1 >= min_words}
    links = similar_lines(nodes)
    assert links  # fuzzy links do exist here
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = line_dedup.dedup_lines(df, min_words=min_words).collect()
    assert Counter((r["doc_id"], r["text_clean"]) for r in got) == Counter(merged_lines(docs, links, min_words))


def linked_share(nodes, links):
    """Share of the similar pairs that have a common key and pass the bit limits, so that they are verified."""
    nodes = sorted(nodes)
    at = {n: k for k, n in enumerate(nodes)}
    keys = np.vstack([line_dedup.Lines([n]).keys(np.asarray([0])) for n in nodes])
    cells = keys.view(np.uint32)
    found = 0
    for a, b in links:
        i, j = at[a], at[b]
        bits = int(np.bitwise_count(keys[i, :2] ^ keys[j, :2]).sum())
        limit = line_dedup.BITS[0 if min(len(a.decode()), len(b.decode())) < line_dedup.SHORT else 1]
        found += bool((cells[i] == cells[j]).any()) and bits <= limit
    return found / len(links)


def test_line_recall_on_documents():
    """Against edit similarity alone, over all pairs of distinct lines of the documents of sf0.01."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    nodes = {n for t in texts for line in (t or "").encode().split(b"\n") if (n := line_dedup.normalised(line))}
    decoded = sorted((n.decode(), n) for n in nodes)
    by_size = sorted(decoded, key=lambda x: len(x[0]))
    ones, twos = np.zeros((len(by_size), 64), np.int16), np.zeros((len(by_size), 512), np.int16)
    for k, (x, _) in enumerate(by_size):
        c = np.frombuffer(x.encode("utf-32-le"), np.uint32)
        ones[k], twos[k] = np.bincount(c & 63, minlength=64), np.bincount((c[1:] * 31 + c[:-1] * 7) & 511, minlength=512)
    sizes = np.asarray([len(x) for x, _ in by_size])
    links = []
    for k in range(len(by_size)):
        stop = np.searchsorted(sizes, sizes[k] / 0.9 + 1e-9, "right")
        # an edit changes two counts of characters and four of pairs of them
        near = np.flatnonzero(np.abs(ones[k + 1 : stop] - ones[k]).sum(axis=1) <= 0.2 * sizes[k + 1 : stop] + 1e-9) + k + 1
        near = near[np.abs(twos[near] - twos[k]).sum(axis=1) <= 0.4 * sizes[near] + 1e-9]
        for j in near:
            if line_dedup.edit_similarity(by_size[k][0], by_size[j][0], 0.9):
                links.append((by_size[k][1], by_size[j][1]))
    assert len(links) > 200
    assert linked_share(nodes, links) >= 0.95


@pytest.mark.parametrize(("words", "least"), [((4, 8), 0.85), ((8, 16), 0.9), ((16, 40), 0.97), ((40, 120), 0.97)])
def test_line_recall_on_changed_words(words, least):
    """One word, and one letter, changed in lines of several lengths."""
    rng = random.Random(9)
    links = []
    while len(links) < 400:
        line = [rng.choice(VOCAB) + rng.choice(VOCAB)[:3] for _ in range(rng.randrange(*words))]
        own, k = list(line), rng.randrange(len(line))
        own[k] = rng.choice(VOCAB) if len(links) % 2 else own[k][:2] + "q" + own[k][3:]
        a, b = " ".join(line).encode(), " ".join(own).encode()
        if a != b and line_dedup.edit_similarity(a.decode(), b.decode(), 0.9):
            links.append((a, b))
    assert linked_share({n for pair in links for n in pair}, links) >= least


def test_hot_line_buckets_are_split(spark, monkeypatch):
    """A bucket of many different lines is dealt by their other keys, and a crowd of similar ones is merged all the same."""
    monkeypatch.setattr(line_dedup, "HOT", 20)
    rng = random.Random(3)
    base = [rng.choice(VOCAB) for _ in range(60)]
    docs = []
    for k in range(120):
        own = list(base)
        own[rng.randrange(60)] = f"{rng.choice(VOCAB)}{rng.choice(VOCAB)}"
        docs.append((k, " ".join(own)))
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sum(r["n_dropped"] for r in got) == 119


def test_lines_of_pieces(monkeypatch):
    """Cutting long texts at line feeds changes neither lines nor positions, and the arrays say what plain splitting says."""
    monkeypatch.setattr(line_dedup, "PIECE", 7)
    bodies = [b"abc\ndefghijkl\nm\n\nn", b"", b"x" * 30, "Q é\n2 b".encode()]
    out = []
    for where, before, texts in line_dedup._pieces(bodies):
        lines = line_dedup.Lines(texts)
        at = 0
        for k, first, piece in zip(where, before, texts, strict=True):
            for j, line in enumerate(piece.split(b"\n")):
                n = line_dedup.normalised(line)
                assert lines.n_words[at] == len(n.split()) and lines.size[at] == len(n.decode())
                out.append((k, first + j, line))
                at += 1
    assert out == [(k, j, line) for k, b in enumerate(bodies) for j, line in enumerate(b.split(b"\n"))]


def test_short_and_spaceless_lines_are_merged(spark, tmp_path):
    cjk = "".join(chr(0x4E00 + (k * k * 7 + k * 31) % 900) for k in range(60))
    texts = ["les.\n\n--\n" + cjk, "Les\n--\n" + cjk[:30] + "\u4e8c" + cjk[31:] + "\nannual report of the board", "annual reports of the board\nother"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in queries.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: (4, 0), 1: (4, 2), 2: (2, 1)}


def test_sim_hashes_count_words():
    """A word set apart from its neighbours still speaks for the line: words in another order share their votes."""
    rng = np.random.default_rng(5)
    words = [v.encode() for v in VOCAB]
    lines = [b" ".join(words[i] for i in rng.permutation(80)) for _ in range(40)]
    sims = line_dedup.sim_hashes(lines)
    apart = [int(np.bitwise_count(sims[i] ^ sims[i + 1]).sum()) for i in range(39)]
    assert np.mean(apart) < 52  # 64 if pairs alone counted


def test_sim_hash_buckets_against_brute_force():
    """Small and large buckets, one block or two, in batches that cut through buckets: all pairs come out with their ids whole."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = []
    for bucket, n in enumerate((2, 5, 9, 40, 3, 17)):
        base = rng.integers(-(2**63), 2**63, 2)
        for _ in range(n):
            high, low = (int(base[0]) ^ (1 << int(rng.integers(0, 60)))), int(base[1]) ^ (int(rng.integers(0, 4)) << 3)
            rows.append([bucket * 10**12, int(rng.integers(-(2**63), 2**63)), high, low])
    want = {(min(a[1], b[1]), max(a[1], b[1])) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and ((a[2] ^ b[2]) % 2**64).bit_count() + ((a[3] ^ b[3]) % 2**64).bit_count() <= 3}
    for blocks in (1, 2):
        dealt = [(b, min(o, k % blocks), max(o, k % blocks), k % blocks, n, n, 50, h, l) for k, (b, n, h, l) in enumerate(rows) for o in range(blocks)]
        dealt.sort(key=lambda r: r[:3])
        columns = [pa.array(c, pa.int64()) for c in zip(*dealt, strict=True)]
        table = pa.RecordBatch.from_arrays(columns, names=["bucket", "x", "y", "own", "node", "g", "size", "high", "low"])
        got, more = set(), False
        for out in line_dedup._compare(1000, [table.slice(k, 13) for k in range(0, table.num_rows, 13)], (3, 3)):
            got |= set(zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True))
            more |= any(m is not None for m in out.column("more").to_pylist())
        assert got == want and not more
        some = [r for out in line_dedup._compare(1, [table], (3, 3)) for r in zip(*(out.column(c).to_pylist() for c in ("a", "b", "more")), strict=True)]
        assert {(a, b) for a, b, _ in some} <= want and any(m is not None for _, _, m in some)


# ---- packing --------------------------------------------------------------------------------
@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.floats(0, 1)), max_size=60), st.integers(1, 6), st.integers(8, 64), st.integers(0, 12))
def test_dot_product_packing_keeps_limits(items, segments, loss_limit, min_cut):
    tokens = np.asarray([t for t, _ in items], np.int64)
    loss = np.asarray([round(t * share) for t, share in items], np.int64)
    out = packing.dot_product_pack(tokens, loss, (64, segments, loss_limit), min_cut)
    pieces = defaultdict(list)
    for sequence in out:
        bears = sum(max(0, min(n, start + n - (tokens[k] - loss[k]))) for k, start, n in sequence)
        assert sum(n for _, _, n in sequence) <= 64 and len(sequence) <= segments and bears <= loss_limit
        for k, start, n in sequence:
            pieces[k].append((start, n))
    assert set(pieces) == set(range(len(items)))
    for k, own in pieces.items():
        at = 0
        for start, n in sorted(own):
            assert start == at and n > 0
            at += n
        assert at == tokens[k]


def plain_pack(tokens, loss, limits, min_cut):
    """Dot-product packing with nothing but lists, each choice over all waiting pieces."""
    waiting = [[t, l, k, 0] for k, (t, l) in enumerate(zip(tokens, loss))]
    out = []
    while waiting:
        waiting.sort(key=lambda p: (p[0], -p[1], p[2]))
        room, seg, bears, sequence = limits[0], limits[1], limits[2], []
        while seg and room and waiting:
            fitting = [p for p in waiting if p[0] <= room and p[1] <= bears]
            if fitting:
                p = max(fitting, key=lambda p: p[0] * room / limits[0] ** 2 + p[1] * bears / limits[2] ** 2)
                waiting.remove(p)
                sequence.append((p[2], p[3], p[0]))
                room, bears, seg = room - p[0], bears - p[1], seg - 1
                continue
            p = max(waiting, key=lambda p: p[0])
            head = min(room, p[0] - p[1] + bears, p[0] - 1)
            if head < max(1, min_cut):
                break
            cost = max(0, head - (p[0] - p[1]))
            sequence.append((p[2], p[3], head))
            room, bears, seg = room - head, bears - cost, seg - 1
            p[0], p[1], p[3] = p[0] - head, p[1] - cost, p[3] + head
        if not sequence:
            return None
        out.append(sequence)
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 40), st.sampled_from([(64, 3, 64), (64, 8, 40), (64, 128, 24), (64, 2, 30)]))
def test_dot_product_packing_chooses_as_a_plain_packer(seed, n, limits):
    """The same number of sequences as the plain packer, and each sequence's filling by its choices, whichever limit binds."""
    rng = np.random.default_rng(seed)
    tokens = rng.permutation(np.arange(1, 65))[:n]  # all different: no ties between pieces
    loss = np.minimum(tokens, rng.integers(0, limits[2] + 1, n))
    want = plain_pack(tokens.tolist(), loss.tolist(), limits, 65)  # nothing is cut, so every choice is one of whole pieces
    if want is not None:
        got = packing.dot_product_pack(tokens, loss, limits, 65)
        value = lambda seqs: [[(t, l) for t, l in ((int(tokens[k]), int(loss[k])) for k, _, _ in q)] for q in seqs]
        assert value(got) == value(want)


def test_packing_has_little_padding(spark):
    out = queries.op2_packing(spark, DATA).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    used = sum(r["n"] for r in out)
    assert sum(2048 - r["n"] for r in out) < 0.02 * used + 2048


def test_instruction_packing(spark):
    df = spark.createDataFrame([(i, " ".join(VOCAB[j % 80] for j in range(i % 40 + 5)), 4) for i in range(60)], "doc_id long, text string, answer long")
    out = packing.pack_documents(df, size=128, segments=4, loss_limit=16, loss_tokens="answer").groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("s"), F.sum("loss_tokens").alias("l")).collect()
    assert all(r["n"] <= 128 and r["s"] <= 4 and r["l"] <= 16 for r in out) and sum(r["l"] for r in out) == 240


# ---- mixing ---------------------------------------------------------------------------------
@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(0, 60))
def test_sainte_lague_is_highest_quotients(weights, seats):
    seats = seats if any(weights) else 0
    heap = sorted(((-w / (2 * k + 1), i, k) for i, w in enumerate(weights) if w for k in range(seats)))[:seats]
    got = mixing.sainte_lague(weights, seats)
    assert got.sum() == seats
    want = np.bincount([i for _, i, _ in heap], minlength=len(weights)) if heap else np.zeros(len(weights), int)
    last = {round(q, 12) for q, _, _ in heap[-1:]}
    if (got != want).any():  # only seats at equal last quotients may go elsewhere
        for i in np.flatnonzero(got != want):
            k = min(got[i], want[i])
            assert round(-weights[i] / (2 * k + 1), 12) in last


def test_mixing(spark, rows):
    got = queries.op8_source_mixing(spark, DATA).collect()
    again = {r["doc_id"]: r["taken"] for r in queries.op8_source_mixing(spark, DATA).collect()}
    sizes = {r["doc_id"]: len(WORD.findall((r["text"] or "").encode())) for r in rows}
    source = {r["doc_id"]: r["source"] for r in rows}
    names = sorted(set(source.values()))
    total = {n: sum(sizes[d] for d in sizes if source[d] == n) for n in names}
    weight = {n: (1, 2, 3)[k % 3] for k, n in enumerate(names)}
    full: set[str] = set()
    while True:  # brute force of the shared targets
        left = sum(total.values()) - sum(3 * total[n] for n in full)
        target = {n: 3 * total[n] if n in full else left * weight[n] / sum(weight[m] for m in names if m not in full) for n in names}
        over = {n for n in names if n not in full and target[n] > 3 * total[n]}
        if not over:
            break
        full |= over
    taken = Counter()
    for r in got:
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == total[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == again[r["doc_id"]]
        taken[source[r["doc_id"]]] += r["taken"]
    for n in names:
        assert abs(taken[n] - target[n]) <= 32, n


def test_mix_rows_are_what_is_taken(spark, rows):
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in rows], "doc_id long, text string, source string, n_chars long")
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}
    got, texts = Counter(), {r["doc_id"]: r["text"] for r in rows}
    for r in mixing.take(df).collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"].encode()))
        assert r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
    assert got == Counter({d: t for d, t in want.items() if t})


def test_many_shards_still_meet_the_targets(spark, rows):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    sums = mixing.mix(df, shard_docs=3).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r["t"] - r["target"]) <= 16 * 8 for r in sums)


def test_one_apportionment_over_very_many_shards(spark):
    """3000 shards of a source get the highest quotients of all of them, none more than three times its words, as a plain ranking says."""
    rng = random.Random(5)
    df = spark.createDataFrame([(k, "w " * rng.choice((1, 7, 40, 40, 41, 300)), "a" if k < 3000 else "b") for k in range(6000)], "doc_id long, text string, source string")
    cells, taken = Counter(), Counter()
    for r in mixing.mix(df, shard_docs=1).collect():
        cells[r["source_size"], r["shard"]] += r["size"]
        taken[r["source_size"], r["shard"]] += r["taken"]
    for source in {s for s, _ in cells}:
        own = {k: n for (s, k), n in cells.items() if s == source}
        got = {k: taken[source, k] // 16 for k in own}
        ranked = sorted((-n / (2 * k + 1), shard) for shard, n in own.items() for k in range(3 * n // 16))[: sum(got.values())]
        assert got == {k: c for k, c in ({k: 0 for k in own} | Counter(k for _, k in ranked)).items()} and len(own) > 1000


# ---- sharding -------------------------------------------------------------------------------
def test_sharding_splits_only_what_is_too_large(spark):
    df = spark.createDataFrame([(i, "x" * ((i * 37) % 400)) for i in range(400)], "doc_id long, text string")
    for probe in (0, 6):  # without probing deeper rounds are needed
        out = sharding.shard(df, limit=900, probe=probe).collect()
        by = defaultdict(list)
        for r in out:
            by[r["shard_depth"], r["shard_prefix"]].append(r)
        hashed = {r["doc_id"]: r["h"] for r in df.select("doc_id", sharding.row_hash(F.col("doc_id"), F.length("text")).alias("h")).collect()}
        size = {r["doc_id"]: r["n_bytes"] for r in out}
        assert len(out) == 400
        for (depth, prefix), own in by.items():
            assert all(hashed[r["doc_id"]] >> (60 - depth) == prefix for r in own)
            assert sum(r["n_bytes"] for r in own) == own[0]["shard_bytes"] <= 900 and len(own) == own[0]["shard_rows"]
            if depth:  # the bucket it was split from was too large
                assert sum(n for d, n in size.items() if hashed[d] >> (61 - depth) == prefix >> 1) > 900


def test_rows_that_no_bit_parts(spark):
    """A row over the limit, and repeated rows over it, end at the first depth that holds nothing else."""
    data = [(k, "x" * 50) for k in range(64)] + [(100, "y" * 2000)] + [(101, "z" * 400)] * 4
    df = spark.createDataFrame(data, "doc_id long, text string")
    for probe in (0, 6):
        out = sharding.shard(df, limit=900, probe=probe).collect()
        own = [r for r in out if not r["fits"]]
        assert Counter(r["doc_id"] for r in own) == {100: 1, 101: 4} and len(out) == len(data)
        depths = {r["doc_id"]: (r["shard_depth"], r["shard_prefix"], r["shard_bytes"]) for r in own}
        hashed = {r["doc_id"]: r["h"] for r in df.select("doc_id", sharding.row_hash(F.col("doc_id"), F.length("text")).alias("h")).collect()}
        for doc, (depth, prefix, size) in depths.items():
            others = [h for d, h in hashed.items() if d != doc]
            assert hashed[doc] >> (60 - depth) == prefix and not any(h >> (60 - depth) == prefix for h in others)
            assert any(h >> (61 - depth) == prefix >> 1 for h in others) and size == (2000 if doc == 100 else 1600)


# ---- quality --------------------------------------------------------------------------------
@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repeated_words(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    want = len({p for i, w in enumerate(windows) if count[w] > 1 for p in range(i, i + 8)})
    body = " ".join(words).encode()
    assert quality.document_facts(body)[0][4] == want


def test_frequent_lines_and_depletion(spark):
    notice = "this notice stands below every page of the host"
    body = lambda k, n: " ".join(VOCAB[(k * 13 + i * i + i) % 80] + str(i * k % 97) for i in range(n))
    data = [(k, body(k, 60) + "\n" + notice.upper(), "h") for k in range(40)] + [(100 + k, body(100, 60), "h") for k in range(30)]
    second = "a second line that all pages of it have too"
    data = [(k, t + "\n" + second, h) if k < 40 else (k, t, h) for k, t, h in data]
    data += [(200, notice + "\n" + second + "\n" + body(7, 6), "h"), (201, notice + "\n" + body(3, 40), "other"), (202, body(9, 30), None)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert all(got[k]["n_frequent_words"] == 19 and got[k]["kept"] for k in range(40))
    assert all(got[100 + k]["kept"] and not got[100 + k]["n_frequent_words"] for k in range(30))  # copies count once
    assert not got[200]["kept"] and not got[200]["base_failed"] and got[201]["kept"] and not got[201]["n_frequent_words"]
    kept = {r["doc_id"]: r for r in quality.keep_good(df).collect()}
    assert 200 not in kept and kept[5]["text"] == body(5, 60) and kept[5]["n_chars"] == len(body(5, 60)) and notice in kept[201]["text"]


def test_lines_of_a_share_of_a_large_host(spark):
    notice = "this notice stands below some pages of the host"
    data = [(k, " ".join(f"{VOCAB[(k + i) % 80]}{k * i}" for i in range(30)) + ("\n" + notice if k % 16 == 0 else "\n" + notice + " too" if k % 25 == 1 else ""), "h") for k in range(800)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    hit = {r["doc_id"] for r in quality.judge(df).filter("n_frequent_words > 0").collect()}
    assert hit == set(range(0, 800, 16))  # 6 % of the texts, while 4 % stay below the share
    hit = {r["doc_id"] for r in quality.judge(df, line_most=25).filter("n_frequent_words > 0").collect()}
    assert hit == set(range(0, 800, 16)) | {k for k in range(800) if k % 25 == 1 and k % 16}


# ---- html, languages, licences ----------------------------------------------------------------
def test_html_against_an_independent_reading(spark):
    got = {r["page_id"]: r for r in queries.op3_html_extraction(spark, DATA).collect()}
    for p in pq.read_table(f"{DATA}/pages.parquet").to_pylist():
        article = p["html"].split("<article>")[1].split("</article>")[0]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", c))).strip() for c in re.split(r"</?(?:p|h1|br)>", article))
        want = " ".join(b for b in blocks if b)
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)


BODY = "This is the clear article body with quite a few words in it, so that nobody takes it for a menu or a footer line at all."
MORE = "A second paragraph of the same article follows here and it says some more about the matter at hand for the reader."
TWO, NAV, FOOT = f"<p>{BODY}</p><p>{MORE}</p>", "<nav><a href=/x>Home</a> <a href=/y>News</a></nav>", "<footer>Copyright 2020 by us</footer>"


@pytest.mark.parametrize(
    "body",
    [
        f"<body class='has-sidebar'>{NAV}<div>{TWO}</div>{FOOT}</body>", f"<body class='page with-footer'>{NAV}<article>{TWO}</article>{FOOT}</body>",
        f"<body>{NAV}<article class='post category-legal'>{TWO}</article>{FOOT}</body>", f"<body><form id=aspnetForm>{NAV}<div>{TWO}</div>{FOOT}</form></body>",
        f"<body><form>{NAV}<article>{TWO}</article>{FOOT}</form></body>", f"<body>{NAV}<article><p data-x=don't>{BODY}</p><p>{MORE}</p><p class='z'></p></article>{FOOT}</body>",
        f'<body>{NAV}<article><p title="abc>{BODY}</p><p>{MORE}</p></article>{FOOT}</body>', f'<body>{NAV}<article><p title="abc>{BODY}</p><p>{MORE}</p><a href="u"></a></article>{FOOT}</body>',
        f"<body>{NAV}<article>{TWO}</article><section id=comments><article class=comment><p>I think this is a great text about this and that.</p></article><div class=reply><p>{BODY} too</p></div></section>{FOOT}</body>",
        f"<body><div id='sidebar-layout'>{NAV}<div>{TWO}</div></div>{FOOT}</body>", f"<body><div id=x>{TWO}</div><div id=comments>{TWO}{TWO}</div>{FOOT}</body>",
        f"<body>{NAV}<main><header><h1>{BODY}</h1></header><div class=\"text\" data-html='<p class=\"ad\">'><p>{MORE}</p></div><form class=newsletter><label>Your mail address, please</label></form></main></body>",
    ],
)
def test_main_text_of_awkward_pages(body):
    assert html_extract.extract_text(f"<html><head><title>T</title></head>{body}</html>", html_extract.trained_tree()) == f"{BODY} {MORE}"


def test_text_signs_and_pictures():
    page = "<article><p>text a<b and c>d is a comparison in it, 1 < 2 as well</p><div class='share-image'><p>The caption of the picture stays here.</p></div><div class='share'>Share this</div></article>"
    assert html_extract.extract_text(page, html_extract.trained_tree()) == "text a<b and c>d is a comparison in it, 1 < 2 as well The caption of the picture stays here."


@pytest.mark.parametrize("piece", ["<a ", '<p x="a>', "<", "</", "<!--", "<p>", "<div>", "</p>", "<span class=ad>", "<a x='", '<p ="', "<b c ", "<div><p></div>"])
def test_pages_are_scanned_in_linear_time(piece):
    begin = time.perf_counter()
    html_extract.text_blocks(piece * 100_000 + '"')
    assert time.perf_counter() - begin < 10


def test_tree_learns_its_table():
    x, y = html_extract.labelled_table()
    assert ((html_extract.trained_tree().predict(x) >= 0.5) == y).all()


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    got = queries.op7_language_id(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_network_against_a_plain_forward_pass(rows):
    """Convolution, pooling, softmax and the mean over windows, one byte and one filter at a time."""
    net = langid.ByteCnn.fresh(["aa", "bb", "cc"], np.random.default_rng(3))
    for b in net.biases:
        b += np.random.default_rng(4).standard_normal(len(b)).astype(np.float32) * 0.1
    bodies = [b"Hello there, this is a short one", (rows[0]["text"] or "x").encode()[:700], None, b"12 34"]
    names, scores = langid.predict_texts(net, net.tables(), bodies, group=2)
    for body, name, score in zip(bodies, names, scores, strict=True):
        if not body or not re.search(rb"[A-Za-z]", body):
            assert (name, score) == ("und", 0.0)
            continue
        low, total = body.lower(), np.zeros(3)
        pieces = [low[i : i + 256] for i in range(0, len(low) - 255, 256)] if len(low) > 256 else [low.ljust(256)]
        if len(low) > 256 and len(low) % 256:
            pieces.append(low[-256:])
        for piece in pieces:
            pooled = []
            for w, bank, bias in zip(langid.WIDTHS, net.banks, net.biases, strict=True):
                responses = [np.concatenate([net.embed[c] for c in piece[i : i + w]]) @ bank + bias for i in range(256 - w + 1)]
                pooled.append(np.maximum(np.max(responses, axis=0), 0))
            z = np.concatenate(pooled) @ net.out + net.out_bias
            total += z - np.log(np.exp(z).sum())
        p = np.exp(total / len(pieces) - (total / len(pieces)).max())
        assert name == net.langs[int(np.argmax(p))] and score == pytest.approx(float(p.max() / p.sum()), rel=1e-4)


def test_windows_cover_the_text():
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 700, 1024):
        body = bytes(rng.integers(97, 123, n, dtype=np.uint8))
        w = langid.windows_of(body)
        whole = w.tobytes()[: n // 256 * 256]
        assert w.shape[1] == 256 and whole == body[: len(whole)] and (n <= 256 or w[-1].tobytes() == body[-256:])
    assert langid.has_letter("1 é".encode()) and langid.has_letter("中".encode()) and not langid.has_letter("12 …!".encode())


@pytest.mark.parametrize(
    ("text", "evaluated", "names", "required"),
    [
        ("MIT", "MIT", ["MIT"], {"MIT"}), ("MIT OR Apache-2.0", "Apache-2.0 OR MIT", ["Apache-2.0", "MIT"], set()), ("MIT AND Apache-2.0", "Apache-2.0 AND MIT", ["Apache-2.0", "MIT"], {"Apache-2.0", "MIT"}),
        ("(MIT AND BSD-3-Clause) OR GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only WITH Classpath-exception-2.0 OR (BSD-3-Clause AND MIT)", ["BSD-3-Clause", "GPL-2.0-only WITH Classpath-exception-2.0", "MIT"], set()), ("MIT */ code", "MIT", ["MIT"], {"MIT"}),
        ("A OR B AND C", "A OR (B AND C)", ["A", "B", "C"], set()), ("A OR A AND B", "A", ["A", "B"], {"A"}), ("A AND (A OR B)", "A", ["A", "B"], {"A"}), ("(A OR A) WITH C", "A WITH C", ["A", "A WITH C"], {"A WITH C"}),
        ("(A AND B) OR (B AND C)", "(A AND B) OR (B AND C)", ["A", "B", "C"], {"B"}), ("A AND (B OR C) AND (D OR E)", "A AND (B OR C) AND (D OR E)", ["A", "B", "C", "D", "E"], {"A"}), ("A OR (B OR (C OR D))", "A OR B OR C OR D", ["A", "B", "C", "D"], set()),
    ],
)
def test_expressions(text, evaluated, names, required):
    terms, named = licenses.evaluate(licenses.to_postfix(text))
    assert (terms.text(), named, terms.required()) == (evaluated, names, required)


def test_expressions_of_any_size_are_evaluated():
    text = " AND ".join(f"(MIT OR GPL-{k}.0)" for k in range(1, 10))
    got = licenses.scan(f"SPDX-License-Identifier: {text}".encode(), licenses.automaton())
    assert got[3] == {"mit", "gpl"} and got[4] == 1.0 and got[5] == [" AND ".join(f"(GPL-{k}.0 OR MIT)" for k in range(1, 10))] and got[6] == set()
    long = licenses.evaluate(licenses.to_postfix(" OR ".join(f"L{k}" for k in range(50_000))))
    assert len(long[0].leaves) == len(long[1]) == 50_000
    deep = "".join(f"A{k} {'OR' if k % 2 else 'AND'} (" for k in range(20_000)) + "Z" + ")" * 20_000
    assert len(licenses.evaluate(licenses.to_postfix(deep))[1]) == 20_001 and "Z" in licenses.evaluate(licenses.to_postfix(deep))[0].text()


def test_and_differs_from_or():
    a = licenses.automaton()
    both, either = (licenses.scan(f"SPDX-License-Identifier: MIT {op} Apache-2.0".encode(), a) for op in ("AND", "OR"))
    assert both[3] == either[3] == {"mit", "apache"} and both[5] != either[5] and both[6] == {"mit", "apache"} and either[6] == set()


@given(st.recursive(st.sampled_from("ABCD"), lambda x: st.tuples(x, st.sampled_from(["AND", "OR"]), x), max_leaves=12))
@settings(max_examples=200, deadline=None)
def test_evaluated_expressions_mean_the_same(tree):
    show = lambda t: t if isinstance(t, str) else f"({show(t[0])} {t[1]} {show(t[2])})"
    holds = lambda t, have: t in have if isinstance(t, str) else (holds(t[0], have) and holds(t[2], have) if t[1] == "AND" else holds(t[0], have) or holds(t[2], have))
    met = lambda t, have: (all if t.op == "AND" else any)([*[x in have for x in t.leaves], *[met(n, have) for n in t.nested]])
    terms, _ = licenses.evaluate(licenses.to_postfix(show(tree)))
    for k in range(16):
        have = {c for i, c in enumerate("ABCD") if k >> i & 1}
        assert holds(tree, have) == met(terms, have)
        assert not holds(tree, have) or terms.required() <= have


def test_dangling_operator_is_passed_over():
    a = licenses.automaton()
    assert licenses.scan(b"SPDX-License-Identifier: MIT and\nmore", a)[3:5] == ({"mit"}, 1.0)
    assert licenses.scan(b"SPDX-License-Identifier: MIT OR GPL-2.0 or with */", a)[3] == {"mit", "gpl"}
    assert licenses.scan(b"SPDX-License-Identifier: and", a)[3] == set()


def test_expression_precedence_and_errors():
    assert licenses.to_postfix("A OR B AND C WITH D") == ["A", "B", "C", "D", "WITH", "AND", "OR"]
    for bad in ("", "OR A", "A OR", "(A", "A AND ()", "(A OR B) WITH C"):
        with pytest.raises(licenses.ExpressionError):
            licenses.evaluate(licenses.to_postfix(bad))


def brute_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_scan_against_brute_force(spark, rows):
    extra = ["MIT-License mit LICENSE, the Apache license general public license Public license", "MIT license license mit licenses", "é mit license é", "SPDX-License-Identifier: (MIT OR GPL-2.0-or-later)\nx", "SPDX-License-Identifier: OR", None, "mit\x00license"]
    data = [(r["doc_id"], r["text"]) for r in rows] + [(10_000 + k, t) for k, t in enumerate(extra)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for doc, text in data:
        r = got[doc]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_scan(text), text
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    assert got[10_003]["labels"] == "gpl,mit" and got[10_003]["score"] == 1.0 and got[10_004]["labels"] == ""


# ---- the pipeline -----------------------------------------------------------------------------
def test_pipeline_stages_against_brute_force(spark, rows):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "exact_dedup", "near_dedup", "source_mixing", "packing"]
    judged = {r["doc_id"] for r in queries.op6_quality_rules(spark, DATA).filter("kept").collect()}
    docs = corpus_pipeline.store(stages["quality_rules"](spark, docs, DATA), "t")
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(got) == judged and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    largest = {}
    for d, t in got.items():
        largest[t] = max(d, largest.get(t, d))
    docs = corpus_pipeline.store(stages["exact_dedup"](spark, docs, DATA), "t")
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(got) == set(largest.values())
    order = sorted(got)
    label = brute_groups([got[d] for d in order])[1]
    docs = corpus_pipeline.store(stages["near_dedup"](spark, docs, DATA), "t")
    assert {r["doc_id"] for r in docs.collect()} == {order[i] for i in set(label)}
    mixed = stages["source_mixing"](spark, docs, DATA)
    assert mixed.columns == docs.columns
    packed = stages["packing"](spark, corpus_pipeline.store(mixed, "t"), DATA)
    assert packed.agg(F.countDistinct("doc_id")).first()[0] == mixed.select("doc_id").distinct().count()

"""Greedy selectors over a pool on the executors equal plain loops, whatever the size of the frontier."""

from __future__ import annotations

import numpy as np
import pytest

from roadsift.operators import greedy
from roadsift.operators import selection as sel


def plain_mmr(score, z, scene, index, ok, budget, most, lam, per_scene, min_gap):
    """Every free row scored anew in every step."""
    out = []
    while len(out) < most:
        cap = per_scene * -(-(len(out) + 1) // budget)
        best = None
        for i in range(len(score)):
            own = [r for r, _, _ in out if scene[r] == scene[i]]
            if not ok[i] or i in [r for r, _, _ in out] or len(own) >= cap or any(abs(index[i] - index[r]) < min_gap for r in own):
                continue
            near = max((min(1.0, max(0.0, float(z[r] @ z[i]))) for r, _, _ in out), default=0.0)
            utility = lam * score[i] - (1 - lam) * near
            if best is None or utility > best[2] + 1e-12:
                best = (i, near, utility)
        if best is None:
            return out
        out.append(best)
    return out


def pool(spark, seed=0, n=90):
    rng = np.random.default_rng(seed)
    z = rng.standard_normal((n, 6))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    z[n // 2] = z[3]
    scene, index, score, ok = np.repeat(np.arange(n // 10), 10), np.tile(np.arange(10), n // 10), np.round(rng.random(n), 1), rng.random(n) > 0.2
    rows = [(i, float(score[i]), z[i].tolist(), int(scene[i]), int(index[i]), bool(ok[i])) for i in range(n)]
    return spark.createDataFrame(rows, "t long, s double, z array<double>, scene int, f int, ok boolean").repartition(3), z, scene, index, score, ok


@pytest.mark.parametrize("frontier", [4096, 7, 1])
@pytest.mark.parametrize(("per_scene", "min_gap", "lam"), [(2, 3, 0.7), (1, 1, 0.3), (None, 2, 0.9), (1, 4, 0.5)])
def test_mmr_against_a_plain_loop(spark, per_scene, min_gap, lam, frontier):
    most = 30 if frontier > 1 else 9
    df, z, scene, index, score, ok = pool(spark, min_gap)
    got, _ = sel.mmr_select(df, "t", "s", "z", "scene", "f", 8, "ok", most, lam, per_scene, min_gap, frontier=frontier)
    want = plain_mmr(score, z, scene, index, ok, 8, most, lam, per_scene or float("inf"), min_gap)
    rows = got.orderBy("rank").collect()
    assert [r["t"] for r in rows] == [r for r, _, _ in want]
    assert [r["rank"] for r in rows] == list(range(1, len(want) + 1))
    assert np.allclose([(r["max_sim"], r["mmr_util"]) for r in rows], [x[1:] for x in want])


def test_mmr_is_nested_and_keeps_its_limits(spark):
    df, _, scene, index, _, ok = pool(spark, 5, 200)
    small, large = (sel.mmr_select(df, "t", "s", "z", "scene", "f", 10, "ok", most, 0.7, 2, 3, frontier=16)[0].orderBy("rank").collect() for most in (10, 20))
    picks = [r["t"] for r in small]
    assert picks == [r["t"] for r in large[:10]] and len(set(picks)) == 10 and ok[picks].all()
    for s in range(20):
        own = sorted(index[i] for i in picks if scene[i] == s)
        assert len(own) <= 2 and all(b - a >= 3 for a, b in zip(own, own[1:], strict=False))


@pytest.mark.parametrize("frontier", [4096, 4])
@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_k_center_against_a_plain_loop(spark, metric, frontier):
    df, z, *_, score, _ = pool(spark, 9, 60)
    far = lambda a, b: 1 - a @ b if metric == "cosine" else np.sqrt(((a - b) ** 2).sum())
    if metric == "l2":
        got, chosen = sel.coreset_l2(df, "t", "z", "s", 14, frontier), [int(np.argmax(score))]
    else:
        mean = z.mean(0) / np.linalg.norm(z.mean(0))
        got, chosen = sel.coreset_cosine(df, "t", "z", 14, frontier), [int(np.argmin(z @ mean))]
    while len(chosen) < 14:
        near = [-1.0 if i in chosen else round(min(float(far(z[i], z[c])) for c in chosen), 12) for i in range(len(z))]
        chosen.append(int(np.argmax(near)))
    assert [r["t"] for r in got.orderBy("rank").collect()] == chosen


def test_k_center_takes_the_whole_pool_once(spark):
    df, *_ = pool(spark, 2, 20)
    assert sorted(r["t"] for r in sel.coreset_l2(df, "t", "z", "s", 50, 6).collect()) == list(range(20))
    assert sel.coreset_l2(df.filter("t < 0"), "t", "z", "s", 5).count() == 0 and sel.coreset_cosine(df.filter("t < 0"), "t", "z", 5).count() == 0


@pytest.mark.parametrize("frontier", [4096, 3])
@pytest.mark.parametrize("most", [10**6, 4])
def test_cover_against_a_plain_loop(spark, monkeypatch, frontier, most):
    monkeypatch.setattr(greedy, "COVERED", most)
    rng = np.random.default_rng(1)
    rows = [(f"t{t:02d}", int(i)) for t in range(25) for i in rng.choice(60, rng.integers(1, 12), replace=False)]
    rows += [("t05", None), ("t30", None)] + [("t31", r[1]) for r in rows if r[0] == "t04"]
    df = spark.createDataFrame(rows, "t string, i int")
    frames = spark.createDataFrame([(t,) for t in sorted({r[0] for r in rows} | {"t40", "t41"})], "t string")
    sets = {r[0]: {i for t, i in rows if t == r[0] and i is not None} for r in frames.collect()}
    want, done = [], set()
    for _ in range(27):
        best = min((t for t in sets if t not in [w for w, _ in want]), key=lambda t: (-len(sets[t] - done), t))
        want.append((best, len(sets[best] - done)))
        done |= sets[best]
    got = sel.max_cover(df, "t", "i", 27, frames, frontier).orderBy("rank").collect()
    assert [(r["t"], r["gain"]) for r in got] == want


def test_choices_are_written_away_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sel, "FLUSH", 5)
    df, *_ = pool(spark, 4, 60)
    whole = sel.mmr_select(df, "t", "s", "z", "scene", "f", 60, None, 60, 0.5, None, 1, frontier=6)[0].orderBy("rank").collect()
    monkeypatch.setattr(sel, "FLUSH", 10**6)
    once = sel.mmr_select(df, "t", "s", "z", "scene", "f", 60, None, 60, 0.5, None, 1)[0].orderBy("rank").collect()
    assert [r["t"] for r in whole] == [r["t"] for r in once] and len(whole) == 60

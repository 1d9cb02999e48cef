"""Rounds of the MMR selector where scenes are full."""

from __future__ import annotations

from test_greedy import plain_mmr, pool

from roadsift.operators import greedy


def test_a_round_goes_on_when_the_cap_rises(spark):
    """F16: rows of full scenes are at hand, so a round no longer ends with every share of the budget."""
    df, z, scene, index, score, ok = pool(spark, 3)
    ready = df.filter("ok").selectExpr("t as token", "scene", "cast(f as long) as idx", "s", "z as v")
    rounds = list(greedy.mmr(ready, 6, 40, 0.95, 1, 1, 30))
    want = plain_mmr(score, z, scene, index, ok, 6, 40, 0.95, 1, 1)
    assert [t for chosen in rounds for t, *_ in chosen] == [i for i, *_ in want]
    assert list(map(len, rounds)) == [26, 14]  # 26, 4 and 10 before: a round ended with the share of the budget


def test_gaps_by_order(spark):
    for near, at, gap, want in (([], 3, 9, False), ([1, 5], 3, 2, False), ([1, 5], 3, 3, True), ([1, 5], 9, 5, True), ([4], 4, 1, True), ([4], 4, 0, False)):
        assert greedy._within(near, at, gap) == want == any(abs(at - x) < gap for x in near)

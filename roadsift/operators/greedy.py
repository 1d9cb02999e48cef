"""Exact greedy selection over pools of any size: executors hold rows and upper bounds, the driver sees a bounded frontier of the best.

In all three selectors a row's value only falls as rows are chosen, so a value computed
earlier is an upper bound.  A round brings the ``frontier`` rows with the best bounds to
the driver, which chooses among them lazily (a row is compared with what was chosen since
it was last looked at only when it is on top) as long as the best of them is ahead of the
best bound outside.  Then the executors bring all bounds up to date with the round's
choices alone, and the next frontier follows.  The first row of a frontier is exact, so
every round chooses at least one row; a pool that fits into the frontier takes one round.

Ties go to the smaller token, on the driver and between frontier and outside alike.  The
pool is never collected; each round's table is in the shared folder.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written

#: Rows and bytes of vectors that come to the driver in a round.
FRONTIER, FRONTIER_BYTES = 4_096, 64 << 20
#: Instances of the sets that come to the driver in a round of coverage.
COVERED = 1_000_000


class Frontier:
    """The rows of a round by falling bound, and the first one outside."""

    def __init__(self, state: DataFrame, bound: str, size: int):
        t = state.orderBy(F.col(bound).desc(), "token").limit(size + 1).toArrow().combine_chunks()
        self.all_here = t.num_rows <= size
        self.rows = t.slice(0, size)
        self.tokens = self.rows.column("token").to_pylist()
        self.bounds = self.rows.column(bound).to_numpy().copy()
        self.outside: tuple[float, Any] | None = None if self.all_here else (-t.column(bound)[size].as_py(), t.column("token")[size].as_py())
        self.open, self.outside_later = len(self.tokens), self.outside
        self._placed()

    def _placed(self) -> None:
        order = sorted(range(len(self.tokens)), key=self.tokens.__getitem__)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))

    def with_closed(self, later: Frontier) -> None:
        """Adds rows, after the ``open`` ones, that cannot be chosen yet; ``outside_later`` is the first one outside once they can."""
        self.rows = pa.concat_tables([self.rows, later.rows]).combine_chunks()
        self.tokens, self.bounds = self.tokens + later.tokens, np.concatenate([self.bounds, later.bounds])
        self.all_here &= later.all_here
        self.outside_later = min((x for x in (self.outside, later.outside) if x is not None), default=None)
        self._placed()

    def ahead(self, bound: float, i: int) -> bool:
        """Whether a row with this exact value comes before everything outside."""
        return self.outside is None or (-bound, self.tokens[i]) < self.outside

    def vectors(self) -> np.ndarray:
        lists = self.rows.column("v").combine_chunks() if self.rows.num_rows else pa.array([], pa.list_(pa.float64()))
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(self.rows.num_rows, -1) if self.rows.num_rows else np.empty((0, 0))


def _size(state: DataFrame, frontier: int) -> int:
    width = state.select(F.size("v").alias("n")).first()
    return max(1, min(frontier, FRONTIER_BYTES // (8 * max(1, width["n"] if width else 1))))


def _dense(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _replaced(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)


def mmr(pool: DataFrame, budget: int, most: int, lam: float, per_scene: float, min_gap: int, frontier: int = FRONTIER) -> Iterator[list[tuple[Any, float, float]]]:
    """Rounds of (token, similarity to the chosen then, utility) of ``pool`` (token, scene, idx, s, v).

    Greedy maximum of lam * s - (1 - lam) * similarity, similarities clipped to [0, 1];
    at most per_scene * ceil(rank / budget) rows of a scene, and none within ``min_gap``
    frames of a chosen row of its scene."""
    state = pool.select("token", "scene", "idx", "s", "v", F.lit(0.0).alias("sim"), (F.lit(lam) * F.col("s")).alias("bound"), F.lit(True).alias("free"))
    if not budget:
        return
    cap_of = lambda done: per_scene * -(-(done + 1) // budget)
    size = _size(state, frontier)
    held: Counter = Counter()  # rows chosen of each scene
    done = 0
    while done < most:
        top = Frontier(state.filter("free"), "bound", size)
        if not top.tokens:
            return
        if any(n >= cap_of(done) for n in held.values()):  # rows of full scenes come back when the cap rises
            top.with_closed(Frontier(state.filter("not free"), "bound", size))
        new = _mmr_round(top, held, done, most, lam, cap_of, min_gap)
        yield [(top.tokens[i], sim, value) for i, sim, value in new]
        done += len(new)
        if done >= most or top.all_here:
            return
        state = written(_mmr_refreshed(state, top, [i for i, *_ in new], held, cap_of(done), lam, min_gap), "mmr-bounds")


def _mmr_round(top: Frontier, held: Counter, done: int, most: int, lam: float, cap_of: Any, min_gap: int) -> list[tuple[int, float, float]]:
    vectors, scenes = top.vectors(), top.rows.column("scene").to_pylist()
    index, score, sim = top.rows.column("idx").to_pylist(), top.rows.column("s").to_numpy(), top.rows.column("sim").to_numpy().copy()
    entries = [(-float(b), int(p), i) for i, (b, p) in enumerate(zip(top.bounds, top.place, strict=True))]
    waiting = entries[: top.open]
    heapq.heapify(waiting)
    seen = [0] * len(scenes)
    near: dict[Any, list[int]] = defaultdict(list)  # sorted frame numbers chosen in this round
    full: dict[Any, list[tuple[float, int, int]]] = defaultdict(list)
    for entry in entries[top.open :]:
        full[scenes[entry[2]]].append(entry)
    chosen = np.empty((min(len(scenes), most - done), vectors.shape[1]))  # vectors of ``new``
    new: list[tuple[int, float, float]] = []
    cap = cap_of(done)
    while done + len(new) < most:
        if (now := cap_of(done + len(new))) != cap:
            cap, top.outside = now, top.outside_later
            for entry in (e for entries in full.values() for e in entries):
                heapq.heappush(waiting, entry)
            full.clear()
        if not waiting:
            break
        bound, place, i = heapq.heappop(waiting)
        scene = scenes[i]
        if _within(near[scene], index[i], min_gap):
            continue
        if held[scene] >= cap:
            full[scene].append((bound, place, i))
            continue
        if seen[i] < len(new):
            newer = chosen[seen[i] : len(new)] @ vectors[i]
            sim[i] = max(sim[i], float(np.clip(newer, 0.0, 1.0).max()))
            seen[i] = len(new)
            heapq.heappush(waiting, (-(lam * float(score[i]) - (1 - lam) * float(sim[i])), place, i))
            continue
        if not top.ahead(-bound, i):
            break
        chosen[len(new)] = vectors[i]
        new.append((i, float(sim[i]), -bound))
        insort(near[scene], index[i])
        held[scene] += 1
    return new


def _within(near: list[int], at: int, gap: int) -> bool:
    """Whether one of the sorted numbers is closer than the gap."""
    k = bisect_left(near, at)
    return (k < len(near) and near[k] - at < gap) or (k > 0 and at - near[k - 1] < gap)


def _mmr_refreshed(state: DataFrame, top: Frontier, new: list[int], held: Counter, cap: float, lam: float, min_gap: int) -> DataFrame:
    """Bounds after the round's choices: those that are out go, rows of full scenes are marked."""
    scenes, index = top.rows.column("scene").to_pylist(), top.rows.column("idx").to_pylist()
    close: dict[Any, list[int]] = defaultdict(list)
    for i in new:
        close[scenes[i]].append(index[i])
    sent = state.sparkSession.sparkContext.broadcast((top.vectors()[new], {top.tokens[i] for i in new}, {s: sorted(x) for s, x in close.items()}, {s for s, n in held.items() if n >= cap}))

    def refresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, gone, near, closed = sent.value
        for batch in batches:
            rows = zip(batch.column("token").to_pylist(), batch.column("scene").to_pylist(), batch.column("idx").to_pylist(), strict=True)
            stays = pa.array([t not in gone and not _within(near.get(s, []), i, min_gap) for t, s, i in rows], pa.bool_())
            batch = batch.filter(stays)
            if not batch.num_rows:
                continue
            sim = batch.column("sim").to_numpy()
            if len(chosen):
                sim = np.maximum(sim, np.clip((_dense(batch) @ chosen.T).max(1), 0.0, 1.0))
            bound = lam * batch.column("s").to_numpy() - (1 - lam) * sim
            free = pa.array([s not in closed for s in batch.column("scene").to_pylist()], pa.bool_())
            yield _replaced(batch, sim=pa.array(sim), bound=pa.array(bound), free=free)

    return state.mapInArrow(refresh, state.schema)


def farthest(vectors: np.ndarray, chosen: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each vector to the nearest of those chosen."""
    if metric == "cosine":
        return (1 - vectors @ chosen.T).min(1)
    out = np.full(len(vectors), np.inf)
    for c in chosen:
        out = np.minimum(out, np.sqrt(((vectors - c) ** 2).sum(1)))
    return out


def k_center(pool: DataFrame, start: Column, budget: int, metric: str = "l2", frontier: int = FRONTIER) -> Iterator[list[tuple[Any]]]:
    """Rounds of tokens of ``pool`` (token, v) in farthest-point order, from the first row in the order of ``start`` (ties by token)."""
    first = pool.orderBy(start, "token").limit(1).select("token", "v").toArrow()
    if not first.num_rows or budget < 1:
        return
    size = _size(pool, frontier)
    token, chosen = first.column("token")[0].as_py(), np.asarray(first.column("v")[0].as_py())[None]
    yield [(token,)]
    done, state, gone = 1, pool.select("token", "v", F.lit(math.inf).alias("far")), {token}
    while done < budget:
        sent = pool.sparkSession.sparkContext.broadcast((chosen, gone))

        def refresh(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # type: ignore[no-untyped-def]
            near, out = sent.value
            for batch in batches:
                batch = batch.filter(pa.array([t not in out for t in batch.column("token").to_pylist()], pa.bool_()))
                if batch.num_rows:
                    yield _replaced(batch, far=pa.array(np.minimum(batch.column("far").to_numpy(), farthest(_dense(batch), near, metric))))

        state = written(state.mapInArrow(refresh, state.schema), "distances")
        top = Frontier(state, "far", size)
        if not top.tokens:
            return
        vectors, value, seen = top.vectors(), top.bounds, [0] * len(top.tokens)
        waiting = [(-float(b), int(p), i) for i, (b, p) in enumerate(zip(value, top.place, strict=True))]
        heapq.heapify(waiting)
        new: list[int] = []
        while waiting and done + len(new) < budget:
            bound, place, i = heapq.heappop(waiting)
            if seen[i] < len(new):
                value[i] = min(value[i], float(farthest(vectors[i][None], vectors[new[seen[i] :]], metric)[0]))
                seen[i] = len(new)
                heapq.heappush(waiting, (-float(value[i]), place, i))
                continue
            if not top.ahead(-bound, i):
                break
            new.append(i)
        yield [(top.tokens[i],) for i in new]
        done, chosen, gone = done + len(new), vectors[new], {top.tokens[i] for i in new}
        if top.all_here:
            return


def max_cover(covers: DataFrame, frames: DataFrame, budget: int, frontier: int = FRONTIER) -> Iterator[list[tuple[Any, int]]]:
    """Rounds of (token, newly covered) of ``frames`` (token), most new instances of ``covers`` (token, inst) first; goes on by token after the gain is 0."""
    covers, left = written(covers.filter("inst is not null").distinct(), "covers"), written(frames.select("token").distinct(), "cover-frames")
    spark, done = frames.sparkSession, 0
    kind = T.StructType([T.StructField("token", left.schema["token"].dataType)])
    while done < budget:
        gains = left.join(covers.groupBy("token").agg(F.count(F.lit(1)).alias("gain")), "token", "left").select("token", F.coalesce("gain", F.lit(0).cast("long")).alias("gain"))
        top = Frontier(gains, "gain", frontier)
        if not top.tokens:
            return
        if not top.bounds[0]:  # nothing new is left: the rest in the order of tokens
            yield [(r["token"], 0) for r in left.orderBy("token").limit(budget - done).collect()]
            return
        size = max(1, int(np.searchsorted(np.cumsum(top.bounds), COVERED, "right")))
        outside = top.outside if size >= len(top.tokens) else (-float(top.bounds[size]), top.tokens[size])
        near = spark.createDataFrame([(t,) for t in top.tokens[:size]], kind)
        sets = {t: set() for t in top.tokens[:size]} | {r["token"]: set(r["s"]) for r in covers.join(F.broadcast(near), "token").groupBy("token").agg(F.collect_list("inst").alias("s")).collect()}
        waiting = [(-int(b), int(p), i) for i, (b, p) in enumerate(zip(top.bounds[:size], top.place[:size], strict=True))]
        heapq.heapify(waiting)
        new: list[tuple[Any, int]] = []
        covered: set = set()
        while waiting and done + len(new) < budget:
            bound, place, i = heapq.heappop(waiting)
            own = sets[top.tokens[i]] - covered
            if len(own) < -bound:
                heapq.heappush(waiting, (-len(own), place, i))
                continue
            if outside is not None and (bound, top.tokens[i]) > outside:
                break
            new.append((top.tokens[i], len(own)))
            covered |= own
        yield new
        done += len(new)
        if done >= budget or outside is None:
            return
        gone = spark.createDataFrame([(t,) for t, _ in new], kind)
        known = covers.join(F.broadcast(gone), "token", "left_semi").select("inst").distinct()
        covers = written(covers.join(known, "inst", "left_anti").select("token", "inst"), "covers")
        left = left.join(F.broadcast(gone), "token", "left_anti")

"""The selection pipelines: camera, LiDAR and object-centred, from feature tables to selections and reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import bround6
from ..functions.scalars import arg_max_reason, top_reasons
from ..operators import evaluation as ev
from ..operators import scoring as sc
from ..operators import selection as sel
from ..operators import similarity as sim
from ..params import Selection, budget_frames


@dataclass
class Result:
    selected: DataFrame
    frames: DataFrame
    warnings: list[str]


def camera_pipeline(features: DataFrame, embeddings: DataFrame, p: Selection) -> Result:
    """features: one row an image under the features contract; embeddings: (sample_token, cam, embedding).

    Scores images, takes each frame's best, averages its cameras' vectors and runs the
    diverse selection; the result carries reasons and a nested ranking up to 10 %."""
    images = features.withColumn("q_ok", sc.quality_flag(min_luma=p.min_luma, min_blur_var=p.min_blur_var))
    frames = sc.frame_scores(images, p.weights, p.cameras)
    chosen = embeddings.withColumn("__c", F.col("cam").isin(*p.cameras))
    vectors = sim.mean_vector(chosen, "sample_token", "embedding", "__c")
    pool = frames.join(vectors, "sample_token").persist()
    n = pool.count()
    budget, most = budget_frames(n, p.budget, floor=False), budget_frames(n, 0.10, floor=False)
    picks, warnings = sel.mmr_select(pool, "sample_token", "S_hybrid", "embedding", "scene_token", "frame_idx", budget, "q_ok", most, p.lam, p.per_scene, p.min_gap, relax=True)
    reason = top_reasons([("novelty", F.col("r_nov")), ("uncertainty", F.col("r_unc")), ("query", F.col("r_qry"))])
    selected = picks.join(frames, "sample_token").withColumns({"reason": reason, "budget_B": F.lit(budget), "method": F.lit("hybrid"), "seed": F.lit(0)})
    return Result(selected, frames, warnings)


def camera_runs(frames: DataFrame, vectors: DataFrame, p: Selection, seeds: Sequence[int] = range(10)) -> dict[str, DataFrame]:
    """Ablations (one component each, no diversity) and random baselines at the same budget: name to (sample_token, rank)."""
    pool = frames.join(vectors, "sample_token").persist()
    budget = budget_frames(pool.count(), p.budget, floor=False)
    run = lambda score, **k: sel.mmr_select(pool, "sample_token", score, "embedding", "scene_token", "frame_idx", budget, "q_ok", None, **({"lam": p.lam, "per_scene": p.per_scene, "min_gap": p.min_gap, "relax": True} | k))[0]
    out = {name: run(score) for name, score in (("nov_only", "S_nov"), ("unc_only", "S_unc"), ("qry_only", "S_qry"))}
    out["no_diversity"] = run("S_hybrid", lam=1.0, per_scene=None, min_gap=1)
    ok = pool.filter("q_ok")
    return out | {f"random_{s}": sel.ranked(sel.random_k(ok, "sample_token", budget, s).select("sample_token"), [sel.random_order(ok, "sample_token", s), F.col("sample_token")]) for s in seeds}


def lidar_pipeline(index: DataFrame, blocks: DataFrame, p: Selection, signals: DataFrame | None = None, seed_vectors: DataFrame | None = None, score: str = "minmax") -> Result:
    """index: LiDAR index; blocks: (sample_token, keep, five arrays); signals: tier-1 (ent, inc, nov) where they exist."""
    vectors = sim.embed_blocks(blocks, "sample_token", ["range", "height", "bev", "clusters", "sensor"], "keep").withColumnRenamed("embedding", "z")
    base = index.join(blocks.select("sample_token", "keep"), "sample_token").join(vectors, "sample_token").persist()
    rar = sim.rarity_knn(base, "sample_token", "z", "scene_token", "keep", p.k, "rar")
    scored = base.join(rar, "sample_token")
    if signals is not None and p.tier == 1:
        scored = scored.join(signals.select("sample_token", "ent", "inc", "nov"), "sample_token", "left")
        scored = scored.withColumn("unc", sc.lidar_uncertainty(scored))
    elif seed_vectors is not None:
        scored = scored.join(sim.novelty_to_seed(scored, seed_vectors, "sample_token", "z", out="nov"), "sample_token")
    scored = sc.lidar_scores(scored, p.weights)
    parts = [(c, w) for c, w in zip(("rar", "nov", "unc"), p.weights, strict=True) if c in scored.columns]
    scored = (sel.minmax_score(scored, parts, "keep", "s_sel") if score == "minmax" else scored.withColumn("s_sel", F.col("s"))).persist()
    kept = scored.filter("keep")
    budget = budget_frames(kept.count(), p.budget)
    m = None if p.per_scene is None else sel.smallest_quota(kept, "scene_token", budget, p.per_scene)
    picks, warnings = sel.mmr_select(scored.select("sample_token", "s_sel", "z", "scene_token", "frame_idx", "keep"), "sample_token", "s_sel", "z", "scene_token", "frame_idx", budget, "keep", None, p.lam, m, 1)
    reason = arg_max_reason([(n, F.col(c)) for n, c, w in zip(("rarity", "novelty", "uncertainty"), ("r_rar", "r_nov", "r_unc"), p.weights, strict=True) if w > 0])
    return Result(picks.join(scored.drop("z"), "sample_token").withColumns({"reason": reason, "budget_B": F.lit(budget)}), scored, warnings)


def rare_pipeline(frames: DataFrame, objects: DataFrame, vectors: DataFrame, context: DataFrame, budget: float = 0.05, lam: float = 0.7, ref_split: str = "V", least_reference: int = 50, frame_unc: DataFrame | None = None) -> Result:
    """frames: (sample_token, scene_token, frame_idx, split, keep); objects: candidates; vectors: (sample_token, z); context: weather_pred, sun_elev_deg."""
    dev = sim.ood_deviation(frames.join(vectors, "sample_token"), "sample_token", "z", "keep")
    gated = sc.gate(frames.join(dev, "sample_token"), objects)
    ref_frames = frames.filter(F.col("split") == ref_split)
    ref_objects = objects.filter(F.col("cls_pred").isin(*sc.VRU_VALUE)).join(ref_frames.select("sample_token"), "sample_token", "left_semi")
    if ref_objects.count() < least_reference:
        raise ValueError(f"the reference split has fewer than {least_reference} road-user objects")
    ref = sc.fit_reference(ref_objects, ref_frames)
    scored = sc.score_objects(objects, ref, frame_unc).persist()
    tagged = sc.frame_tags(scored, gated.join(context, "sample_token", "left"), ref)
    pool = frames.join(tagged, "sample_token").join(vectors, "sample_token").withColumn("ok", F.col("gate") == "valid").persist()
    picks, warnings = sel.rare_select(pool, "sample_token", "s_frame", "z", "scene_token", "frame_idx", "ok", sel.track_penalty(scored, "sample_token", "track_id", "s_obj"), budget_frames(pool.filter("ok").count(), budget), lam)
    return Result(picks.join(tagged, "sample_token"), tagged, warnings)


def evaluate_runs(runs: Mapping[str, DataFrame], pool: DataFrame, rare: str = "is_rare", scene: str = "scene_token") -> DataFrame:
    """Metrics of every run, one row a run."""
    out: DataFrame | None = None
    for name, run in runs.items():
        own = ev.selection_metrics(pool, run, "sample_token", rare, scene).withColumn("run", F.lit(name))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no runs")
    return out


def tune(pool: DataFrame, run: Callable[[dict[str, object]], DataFrame], grid: Sequence[dict[str, object]], criterion: Callable[[DataFrame], tuple[float, float]], default: Mapping[str, object]) -> dict[str, object]:
    """Grid point with the best (criterion, recall, closeness to the default)."""
    close = lambda g: -sum(g[k] != default.get(k) for k in g)
    return max(grid, key=lambda g: (*criterion(run(g)), close(g)))


def weight_grid(step: float = 0.25) -> list[tuple[float, float, float]]:
    """Weights on the simplex."""
    n = round(1 / step)
    return [(a * step, b * step, (n - a - b) * step) for a in range(n + 1) for b in range(n + 1 - a)]


def tier0_grid() -> list[dict[str, object]]:
    return [{"k": k, "lam": lam, "per_scene": m} for k in (5, 10, 20) for lam in (0.5, 0.7, 0.9, 1.0) for m in (2, 4, 8, None)]


def bench_report(rankings: Mapping[str, DataFrame], pool: DataFrame, truth: DataFrame, fractions: Sequence[float] = (0.01, 0.02, 0.05, 0.10), n_boot: int = 1000, seed: int = 0, ours: str = "OURS") -> DataFrame:
    """Yield of each ranking per budget with the paired interval against ours, Holm-adjusted p and the verdict.

    rankings: (sample_token, rank); pool: (sample_token, scene_token); truth: (sample_token, instance, scene_token)."""
    spark = pool.sparkSession
    n = pool.count()
    draws = ev.hash_draws(spark, pool, "scene_token", n_boot, seed).persist()
    scenes = pool.select("scene_token").distinct()
    rows: DataFrame | None = None
    for fraction in fractions:
        budget = budget_frames(n, fraction)
        stats: DataFrame | None = None
        for name, ranking in rankings.items():
            chosen = sel.prefix(ranking, pool, "sample_token", budget).select("sample_token")
            cap = truth.join(chosen, "sample_token", "left_semi").groupBy("scene_token").agg(F.count_distinct("instance").alias("cap"))
            num = pool.join(chosen, "sample_token", "left_semi").groupBy("scene_token").agg(F.count(F.lit(1)).alias("n_sel"))
            own = scenes.join(cap, "scene_token", "left").join(num, "scene_token", "left").na.fill(0).withColumn("method", F.lit(name))
            stats = own if stats is None else stats.unionByName(own)
        values = ev.bootstrap_ratio(stats, draws, "method", "scene_token", "cap", "n_sel").persist()  # type: ignore[arg-type]
        point = stats.groupBy("method").agg((F.sum("cap") / F.lit(max(budget, 1))).alias("iy"))  # type: ignore[union-attr]
        mine = values.filter(F.col("method") == ours).select("b", F.col("value").alias("o"))
        delta = values.filter(F.col("method") != ours).join(mine, "b").withColumn("delta", F.col("o") - F.col("value"))
        ci = ev.percentile_ci(delta, "delta", ["method"]).join(ev.bootstrap_p(delta, "delta", ["method"]), "method")
        ci = ev.holm(ci, "method", "p").withColumn("verdict", ev.report_verdict(F.col("low"), F.col("high")))
        own = point.join(ci, "method", "left").withColumns({"budget": F.lit(fraction), "B": F.lit(budget)})
        rows = own if rows is None else rows.unionByName(own)
    return rows.select("budget", "B", "method", *[bround6(F.col(c)).alias(c) for c in ("iy", "mean", "low", "high", "p", "p_holm")], "verdict")  # type: ignore[union-attr]


ENGINES: dict[str, Callable[..., Result]] = {"camera": camera_pipeline, "lidar": lidar_pipeline, "rare": rare_pipeline}


def engine(name: str) -> Callable[..., Result]:
    if name not in ENGINES:
        raise KeyError(f"unknown engine {name}; there are {', '.join(ENGINES)}")
    return ENGINES[name]


def with_fallback(run: Callable[[], Result], fallback: Callable[[], Result], missing: type[Exception] = FileNotFoundError) -> Result:
    """A run that falls back when its optional inputs are missing or stale, with a warning."""
    try:
        return run()
    except missing as e:
        out = fallback()
        out.warnings.append(f"fell back: {e}")
        return out

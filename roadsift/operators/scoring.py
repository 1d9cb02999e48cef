"""Scores of images, frames, LiDAR frames and objects; gates, tags and reasons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import bround6, pct_rank, weighted, with_group_pct_rank, with_pct_rank
from ..functions.scalars import arg_max_reason, cell_key, relative_change, shape_score, surprisal, tags_from
from ..schemas import CAMERAS
from ..scratch import written
from .aggregates import detections_per_image, exact_percentiles, quantiles_higher
from .joins import previous_value

# Weights of the object score and of the frame score, and group values of road users.
OBJECT_WEIGHTS = {"shape": 0.15, "slice": 0.35, "vru": 0.30, "unc": 0.20}
FRAME_WEIGHTS = (0.70, 0.15, 0.15)
VRU_VALUE = {"pedestrian": 1.0, "bicycle": 1.0, "motorcycle": 1.0, "vru_unknown": 0.5}
BAD_WEATHER = ("rain", "fog", "snow")
TWILIGHT = -6.0


def quality_flag(bright: str = "q_bright", blur: str = "q_blur", detections: str = "det_n", min_luma: float = 8.0, min_blur_var: float = 15.0) -> Column:
    return (F.col(bright) >= min_luma) & (F.col(blur) >= min_blur_var) & (F.col(detections) >= 1)


def image_uncertainty(frames: DataFrame, dets: DataFrame) -> DataFrame:
    """det_n, det_ent, det_n_conf, det_tmp and unc of every image (sample_token, cam, scene_token, frame_idx)."""
    per = detections_per_image(dets, ["sample_token", "cam"])
    met = frames.join(per, ["sample_token", "cam"], "left").na.fill(0, ["det_n", "det_ent", "det_n_conf"])
    now = F.col("det_n_conf").cast("double")
    before = previous_value(now, ["scene_token", "cam"], "frame_idx")
    met = met.withColumn("det_tmp", F.when(before.isNull(), F.lit(0.0)).otherwise(relative_change(now, before)))
    return met.withColumn("unc", 0.5 * F.col("det_ent") + 0.5 * F.col("det_tmp"))


def image_scores(df: DataFrame, weights: tuple[float, float, float], cameras: Sequence[str] = CAMERAS, by: str | None = "split") -> DataFrame:
    """Percentile ranks of eligible images by split and their weighted sum ``s``; others have zeros."""
    eligible = F.col("q_ok") & F.col("cam").isin(*cameras)
    scored = written(df.withColumn("eligible", eligible), "images")
    ranks = ("r_nov", "r_unc", "r_qry")
    for name, c in zip(ranks, ("nov_knn", "unc", "qry_max"), strict=True):  # in sorted ranges: no task sorts a split
        scored = written(with_group_pct_rank(scored.withColumn("__v", F.when(F.col("eligible"), F.col(c))), "__v", [by] if by else [], name, constant_is_zero=False).drop("__v"), "images")
    total = weighted([(w, F.col(c)) for w, c in zip(weights, ranks, strict=True)])
    return scored.withColumn("s", F.when(F.col("eligible"), total).otherwise(F.lit(0.0)))


def frame_scores(df: DataFrame, weights: tuple[float, float, float], cameras: Sequence[str] = CAMERAS) -> DataFrame:
    """One row a frame: the best eligible image (first camera on ties), maxima of the ranks, any eligible, camera count."""
    scored = image_scores(df, weights, cameras)
    place = F.array_position(F.array(*[F.lit(c) for c in CAMERAS]), F.col("cam"))
    best = F.max(F.struct(F.when(F.col("eligible"), F.col("s")).otherwise(F.lit(-1.0)).alias("k"), (-place).alias("o"), F.col("cam"), F.col("s"), F.col("r_nov"), F.col("r_unc"), F.col("r_qry"), F.col("qry_best"), F.col("det_n_conf")))
    out = scored.groupBy("sample_token", "scene_token", "split", "frame_idx").agg(
        best.alias("b"), F.max("r_nov").alias("S_nov"), F.max("r_unc").alias("S_unc"), F.max("r_qry").alias("S_qry"), F.bool_or("eligible").alias("q_ok"), F.count(F.lit(1)).alias("n_cams")
    )
    return out.select(
        "sample_token", "scene_token", "split", "frame_idx", F.col("b.cam").alias("best_cam"), bround6(F.col("b.s")).alias("S_hybrid"), "S_nov", "S_unc", "S_qry",
        F.col("b.r_nov").alias("r_nov"), F.col("b.r_unc").alias("r_unc"), F.col("b.r_qry").alias("r_qry"), F.col("b.qry_best").alias("qry_best"), "q_ok", "n_cams", F.col("b.det_n_conf").alias("det_n_conf_best"),
    )


def lidar_scores(df: DataFrame, weights: tuple[float, float, float], keep: str = "keep") -> DataFrame:
    """Ranks of rarity, novelty and uncertainty on kept frames and their weighted sum, six decimals."""
    ranks = [f"r_{c}" for c in ("rar", "nov", "unc")]
    rows, scored = df.count(), df
    for c in ("rar", "nov", "unc"):
        scored = with_pct_rank(scored, c, f"r_{c}", keep, rows=rows) if c in df.columns else scored.withColumn(f"r_{c}", F.lit(0.0))
    return scored.withColumn("s", bround6(F.when(F.col(keep), weighted([(w, F.col(c)) for w, c in zip(weights, ranks, strict=True)])).otherwise(F.lit(0.0))))


def lidar_uncertainty(df: DataFrame, keep: str = "keep") -> Column:
    """Half the rank of entropy and half the rank of inconsistency."""
    return 0.5 * pct_rank(F.col("ent"), F.col(keep)) + 0.5 * pct_rank(F.col("inc"), F.col(keep))


def keep_frames(points: DataFrame, frame: str = "sample_token", close: float = 1.0, least: int = 2000) -> DataFrame:
    """n_points after removal of the vehicle's own returns, keep and reason."""
    own = (F.abs(F.col("x")) < close) & (F.abs(F.col("y")) < close)
    counts = points.groupBy(frame).agg(F.count_if(~own).alias("n_points"), F.count_if(F.col("x").isNull()).alias("unread"))
    reason = F.when(F.col("unread") > 0, F.lit("read_error")).when(F.col("n_points") < least, F.lit("few_points")).otherwise(F.lit(""))
    return counts.select(frame, "n_points", (reason == "").alias("keep"), reason.alias("reason"))


def gate(frames: DataFrame, objects: DataFrame, keep: str = "keep", min_points: int = 10, sigma: float = 3.0) -> DataFrame:
    """gate, gate_fail and ood_flag of each frame; ``frames`` has deviation and spread, ``objects`` pts. The first rule that holds decides."""
    per = objects.groupBy("sample_token").agg(F.count(F.lit(1)).alias("__n"), F.max("pts").alias("__pts"))
    met = frames.join(per, "sample_token", "left")
    far = F.col("deviation") / F.greatest(F.col("spread"), F.lit(1e-12))
    fail = (
        F.when(~F.col(keep), F.lit("lidar_filtered")).when(F.coalesce(F.col("__n"), F.lit(0)) == 0, F.lit("no_candidates"))
        .when(far > 2 * sigma, F.lit("ood")).when(F.col("__pts") < min_points, F.lit("all_below_min_pts")).otherwise(F.lit(""))
    )
    kind = F.when(fail == "lidar_filtered", F.lit("outlier")).when(fail != "", F.lit("suspect")).otherwise(F.lit("valid"))
    return met.withColumns({"gate": kind, "gate_fail": fail, "ood_flag": F.coalesce(far > sigma, F.lit(False))}).drop("__n", "__pts")


@dataclass
class Reference:
    """Small tables fitted on the reference split: class priors, bin edges, cell frequencies, size statistics, thresholds."""

    classes: DataFrame
    edges: DataFrame
    cells: DataFrame
    sizes: DataFrame
    thresholds: DataFrame
    objects: DataFrame  # those it was fitted on, with their cells


def class_edges(objects: DataFrame, kind: str, values: Sequence[str]) -> DataFrame:
    """Distinct quartiles ('higher') of each value by class, as arrays."""
    edges = F.array_sort(F.array_distinct(F.array("q0", "q1", "q2")))
    return quantiles_higher(objects, [kind], values, (0.25, 0.5, 0.75)).groupBy(kind).agg(*[F.max(F.when(F.col("name") == v, edges)).alias(f"{v}_edges") for v in values])


def with_cells(objects: DataFrame, edges: DataFrame, kind: str, distance: str = "dist_m", points: str = "pts") -> DataFrame:
    met = objects.join(edges, kind, "left")
    at_least = lambda v, k: F.when(F.get(f"{v}_edges", F.lit(k)) <= F.col(v), 1).otherwise(0)
    place = lambda v: at_least(v, 0) + at_least(v, 1) + at_least(v, 2)  # noqa: E731  # plain comparisons: at most three edges
    return met.withColumn("cell", cell_key(F.col(kind), place(distance), place(points))).drop(f"{distance}_edges", f"{points}_edges")


def fit_reference(objects: DataFrame, frames: DataFrame, kind: str = "cls_pred", distance: str = "dist_m", points: str = "pts", alpha: float = 0.10, sides: Sequence[str] = ("l", "w", "h")) -> Reference:
    """Prediction-side reference: priors by object, cells by frame share (empty frames count), thresholds padded with zeros.

    The objects are stored once; every statistic reads that table and adds the cells, which are
    comparisons with a small table, and the small tables of the reference are stored too."""
    base = written(objects, "objects")
    edges = written(class_edges(base, kind, [distance, points]), "edges")
    celled = with_cells(base, F.broadcast(edges), kind, distance, points)  # edges: a row a class
    tokens = written(frames.select("sample_token").distinct(), "frames")
    n_objects, n_frames = base.count(), tokens.count()
    spread = [a for s in sides for a in (F.median(s).alias(f"{s}_median"), F.greatest(F.stddev_pop(s), F.lit(0.05)).alias(f"{s}_std"))]
    of_class = written(celled.groupBy(kind).agg(F.count(F.lit(1)).alias("__n"), *spread), "classes")  # a row a class
    classes = of_class.select(kind, (F.col("__n") / F.lit(max(1, n_objects))).alias("class_p"))
    cells = written(celled.select("sample_token", "cell").distinct().groupBy("cell").agg((F.count(F.lit(1)) / F.lit(max(1, n_frames))).alias("cell_p")), "cells")
    worst = celled.join(classes, kind).join(cells, "cell").groupBy("sample_token").agg(F.max(surprisal(F.col("class_p"))).alias("u1"), F.max(surprisal(F.col("cell_p"))).alias("u2"))
    padded = tokens.join(worst, "sample_token", "left").select(F.coalesce("u1", F.lit(0.0)).alias("u1"), F.coalesce("u2", F.lit(0.0)).alias("u2"))
    cuts = {r["name"]: r["q0"] for r in quantiles_higher(padded, [], ["u1", "u2"], [1 - alpha]).collect()}
    thresholds = objects.sparkSession.createDataFrame([(cuts.get("u1"), cuts.get("u2"))], "t1 double, t2 double")
    return Reference(classes, edges, cells, of_class.drop("__n"), thresholds, celled)


def score_objects(objects: DataFrame, ref: Reference, frame_unc: DataFrame | None = None, kind: str = "cls_pred", sides: Sequence[str] = ("l", "w", "h")) -> DataFrame:
    """shape, slice, vru and unc scores, s_obj and its reason. Objects of class other, or unseen, have shape 0; unseen cells have slice 1."""
    vru = F.coalesce(F.create_map(*[F.lit(x) for kv in VRU_VALUE.items() for x in kv])[F.col(kind)], F.lit(0.0))
    met = (objects if "cell" in objects.columns else with_cells(objects, ref.edges, kind)).join(ref.cells, "cell", "left").join(ref.sizes, kind, "left")
    met = met.join(frame_unc.select("sample_token", F.col("unc").alias("__unc")), "sample_token", "left") if frame_unc is not None else met.withColumn("__unc", F.lit(0.0))
    z = [(F.col(s) - F.col(f"{s}_median")) / F.col(f"{s}_std") for s in sides]
    u = surprisal(F.col("cell_p"))
    is_vru = vru > 0
    met = met.withColumns({
        "score_shape": F.when((F.col(kind) != "other") & F.col(f"{sides[0]}_median").isNotNull(), shape_score(z)).otherwise(F.lit(0.0)),
        "score_vru": vru, "score_unc": F.coalesce(F.col("__unc"), F.lit(0.0)), "__u": F.when(is_vru, F.least(u, F.lit(1e6))),
    })
    unseen = is_vru & F.col("cell_p").isNull()
    met = written(met.withColumn("__vru", is_vru), "object-signals")
    met = with_pct_rank(met, "__u", "__slice", "__vru", rows=met.count())
    met = met.withColumn("score_slice", F.when(unseen, F.lit(1.0)).otherwise(F.col("__slice")))
    parts = [(name, F.col(f"score_{name}")) for name in OBJECT_WEIGHTS]
    total = F.least(F.lit(1.0), F.greatest(F.lit(0.0), weighted([(w, F.col(f"score_{n}")) for n, w in OBJECT_WEIGHTS.items()])))
    drop = [c for s in sides for c in (f"{s}_median", f"{s}_std")]
    return met.withColumns({"s_obj": total, "reasons": arg_max_reason(parts)}).drop("__unc", "__u", "__vru", "__slice", *drop)


def fuse_semantic(objects: DataFrame, semantic: DataFrame, weight: float = 0.3) -> DataFrame:
    """(1 - w) s + w max(r_sem, hit); the reason is replaced where semantics leads."""
    met = objects.join(semantic.select("sample_token", "object_id", "r_sem", "concept_top", "concept_score"), ["sample_token", "object_id"], "left")
    best = F.greatest(F.coalesce("r_sem", F.lit(0.0)), F.coalesce("concept_score", F.lit(0.0)))
    lead = F.col("r_sem").isNotNull() & (best > F.col("s_obj"))
    fused = F.when(F.col("r_sem").isNull(), F.col("s_obj")).otherwise((1 - weight) * F.col("s_obj") + weight * best)
    reason = F.when(lead, F.concat(F.lit("semantic p"), F.bround(best * 100).cast("int").cast("string"))).otherwise(F.col("reasons"))
    return met.withColumns({"__f": fused, "reasons": reason}).drop("s_obj").withColumnRenamed("__f", "s_obj")


def frame_tags(objects: DataFrame, frames: DataFrame, ref: Reference, kind: str = "cls_pred", far: float = 30.0, few: int = 10, v_min: float = 0.5, x_max: float = 20.0, y_abs: float = 4.0, evidence: bool = True) -> DataFrame:
    """s_frame (rank of the raw score on valid frames), pred_tags R1|R2|R3|H|C|I and, unless it is not wanted, evidence.

    ``frames`` has gate, weather_pred and sun_elev_deg; objects of outlier frames do not count.
    Evidence names objects, which takes a sort of all objects by frame; the rest is hashed."""
    vru = F.col(kind).isin(*VRU_VALUE)
    met = with_cells(objects, ref.edges, kind) if "cell" not in objects.columns else objects
    met = met.drop("class_p", "cell_p").join(ref.classes, kind, "left").join(ref.cells, "cell", "left")
    t1, t2 = (F.lit(x) for x in ref.thresholds.first())
    u1, u2 = surprisal(F.col("class_p")), surprisal(F.col("cell_p"))
    mover = vru & (F.col("speed_mps") >= v_min)
    per = met.groupBy("sample_token").agg(
        F.max("s_obj").alias("s_objects"), F.count_if(vru).alias("crowd"),
        F.bool_or(vru & (u1 > t1)).alias("R1"), F.bool_or(vru & (u2 > t2)).alias("R2"), F.bool_or(mover).alias("moves"),
        F.bool_or((F.col("dist_m") > far) | (F.col("pts") < few)).alias("H"),
        F.bool_or(mover & (F.col("cx") > 0) & (F.col("cx") <= x_max) & (F.abs(F.col("cy")) <= y_abs)).alias("I"),
        *([F.max(F.when(vru, F.struct(u.alias("u"), F.col("object_id")))).alias(e) for e, u in (("e1", u1), ("e2", u2))] if evidence else []),
    )
    base = frames.join(per, "sample_token", "left")
    on = {c: F.coalesce(F.col(c), F.lit(False)) & (F.col("gate") != "outlier") for c in ("R1", "R2", "moves", "H", "I")}
    hard_context = F.coalesce(F.col("weather_pred").isin(*BAD_WEATHER), F.lit(False)) | F.coalesce(F.col("sun_elev_deg") < TWILIGHT, F.lit(False))
    inlier = F.col("gate") != "outlier"
    a, b, c = FRAME_WEIGHTS
    raw = a * F.when(inlier, F.coalesce("s_objects", F.lit(0.0))).otherwise(F.lit(0.0)) + b * F.least(F.when(inlier, F.coalesce("crowd", F.lit(0))).otherwise(F.lit(0)) / 5.0, F.lit(1.0)) + c * F.when(hard_context, F.lit(0.3)).otherwise(F.lit(0.0))
    tags = tags_from([("R1", on["R1"]), ("R2", on["R2"]), ("R3", on["moves"] & hard_context), ("H", on["H"]), ("C", hard_context), ("I", on["I"])])
    out = base.withColumns({"raw": raw, "pred_tags": F.array_join(tags, "|"), "__valid": F.col("gate") == "valid"})
    if evidence:
        out = out.withColumn("evidence", F.to_json(F.struct(F.when(on["R1"], F.col("e1.object_id")).alias("R1"), F.when(on["R2"], F.col("e2.object_id")).alias("R2"))))
    given = ["evidence"] if evidence else []
    out = written(out.select("sample_token", "gate", "s_objects", "crowd", "raw", "pred_tags", "__valid", *given), "frame-signals")
    out = with_pct_rank(out, "raw", "s_frame", "__valid", rows=out.count())
    return out.select("sample_token", "gate", F.coalesce("s_objects", F.lit(0.0)).alias("s_objects"), F.coalesce("crowd", F.lit(0)).alias("crowd"), "s_frame", "pred_tags", *given)


def overview(frames: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Pool overview of scored frames (S_hybrid, r_nov, r_unc, r_qry, q_ok, det_n_conf_best; any_ok, dark, blurry of its images)."""
    high = F.lit(exact_percentiles(frames.filter("q_ok"), "S_hybrid", [0.9])[0])
    unlabelable = ~F.col("q_ok") & ~F.col("any_ok")
    flagged = frames.withColumns({
        "too_safe": F.col("q_ok") & (F.col("r_nov") <= 0.3) & (F.col("r_qry") <= 0.3),
        "easy": F.col("q_ok") & (F.col("r_unc") <= 0.2) & (F.col("det_n_conf_best") >= 1),
        "unlabelable": F.when(unlabelable, F.when(F.col("dark"), F.lit("dark")).when(F.col("blurry"), F.lit("blurry")).otherwise(F.lit("no_objects"))),
        "camera_excluded": ~F.col("q_ok") & F.col("any_ok"), "high_value": F.col("q_ok") & (F.col("S_hybrid") >= high),
    })
    return flagged.join(groups, "sample_token", "left") if groups is not None else flagged

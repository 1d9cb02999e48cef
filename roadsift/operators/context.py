"""Context rules: image flags, per-axis decisions, fusion, threshold fitting."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import arg_max, softmax, top2_margin
from .joins import require_subset

# Axes, their normal classes, sun bands in degrees.
AXES = ("illum", "glare", "lens", "weather")
NORMAL = {"illum": "day", "glare": "none", "lens": "clean", "weather": "dry"}
SUN = {"night_deg": -6.0, "lowlight_deg": 6.0}
OK, DISAGREE, SOFT = "OK", "DISAGREE", "SOFT"
#: Quantiles of the fitted thresholds.
FLAG_QUANTILES = {"glare_sat_frac": ("sat_frac", 0.975), "glare_blob": ("blob_max_frac", 0.95), "tile_range": ("tile_range", 0.975), "veil": ("veil", 0.975), "night_v_mean": ("v_mean", 0.025), "blur_sharp_ratio": ("sharp_ratio", 0.025)}
MARGIN_QUANTILE, MARGIN_FALLBACK, REVIEW_MOST = 0.20, 0.10, 0.15


def cv_flags(thr: Mapping[str, float]) -> dict[str, Column]:
    saturated = F.col("sat_frac") >= thr["glare_sat_frac"]
    return {
        "NIGHT": F.col("v_mean") < thr["night_v_mean"],
        "GLARE": (saturated & (F.col("blob_max_frac") >= thr["glare_blob"])) | ((F.col("tile_range") >= thr["tile_range"]) & saturated),
        "BLUR": F.col("sharp_ratio") < thr["blur_sharp_ratio"],
        "VEIL": F.col("veil") >= thr["veil"],
    }


def strong(m: float) -> float:
    """The margin that counts as certain: twice the threshold, but always within reach."""
    return min(2 * m, (1 + m) / 2)


def _verdict(tag: Column | str | None, status: str) -> Column:
    text = F.lit(None).cast("string") if tag is None else (F.lit(tag) if isinstance(tag, str) else tag)
    return F.struct(text.alias("tag"), F.lit(status).alias("status"))


def decide(axis: str, cls: Column, margin: Column, m: float, flags: Mapping[str, Column], sun: Column) -> Column:
    """(tag, status) of one axis; rules in order, the first that holds decides."""
    sure, none = margin >= strong(m), _verdict(None, SOFT)
    if axis == "illum":
        band = F.when(sun < SUN["night_deg"], F.lit("night")).when(sun < SUN["lowlight_deg"], F.lit("lowlight")).otherwise(F.lit("day"))
        opposite = ((cls == "day") & (band == "night")) | ((cls == "night") & (band == "day"))
        return (
            F.when(sun.isNotNull() & (margin >= m) & opposite, _verdict(None, DISAGREE)).when(sun.isNotNull(), _verdict(band, OK)).when(margin < m, none)
            .when((cls == "night") & ~(flags["NIGHT"] | flags["GLARE"] | sure), none).otherwise(_verdict(cls, OK))
        )
    if axis == "glare":
        tag = F.concat(F.lit("glare_"), cls)
        return (
            F.when((cls == "none") & flags["GLARE"] & (margin >= m), _verdict(None, DISAGREE)).when(cls == "none", _verdict("none", OK))
            .when((cls == "sun") & F.coalesce(sun < 0, F.lit(False)), none).when((flags["GLARE"] | flags["VEIL"]) & (margin >= m), _verdict(tag, OK))
            .when(sure, _verdict(tag, OK)).when(margin >= m, _verdict(None, DISAGREE)).otherwise(none)
        )
    if axis == "lens":
        return F.when((cls == "clean") & (margin >= m), _verdict("clean", OK)).when((cls == "clean") | (margin < m), none).when(flags["BLUR"] | flags["VEIL"], _verdict(cls, OK)).otherwise(none)
    return F.when(F.coalesce(sun < SUN["night_deg"], F.lit(False)), none).when(margin < m, none).when(cls == "dry", _verdict("dry", OK)).when(sure, _verdict(cls, OK)).otherwise(none)


def axis_probabilities(similarities: Column, temperature: float = 100.0) -> Column:
    return softmax(F.transform(similarities, lambda s: s * temperature))


def fuse(df: DataFrame, classes: Mapping[str, Sequence[str]], thr: Mapping[str, Mapping[str, float]] | None, version: str = "ctx_v1.1") -> DataFrame:
    """Context of every image from p_<axis> arrays, quality features and ``sun_elev_deg``.

    Unreadable images go to review without tags; without thresholds there are no tags and no review."""
    margins = {f"margin_{a}": F.coalesce(top2_margin(F.col(f"p_{a}")), F.lit(0.0)) for a in AXES}
    out = df.withColumns(margins)
    probs = {a: F.to_json(F.map_from_arrays(F.array(*[F.lit(c) for c in classes[a]]), F.transform(F.col(f"p_{a}"), lambda x: F.bround(x, 6)))) for a in AXES}
    empty = F.lit(None).cast("string")
    if thr is None:
        return out.withColumns({f"tag_{a}": empty for a in AXES} | {"cv_flags": F.lit(""), "review": F.lit(False), "review_reasons": F.lit("CONTEXT_NOT_FROZEN"), "context_version": F.lit(version)} | {f"p_{a}": probs[a] for a in AXES})
    flags = cv_flags(thr["cv"])
    verdicts = {a: decide(a, F.element_at(F.array(*[F.lit(c) for c in classes[a]]), arg_max(F.col(f"p_{a}")) + 1), F.col(f"margin_{a}"), thr["margin"][a], flags, F.col("sun_elev_deg")) for a in AXES}
    out = out.withColumns({f"__{a}": F.when(F.col("img_ok"), v) for a, v in verdicts.items()})
    names = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(f"{name}_CV")) for name, cond in flags.items()]))
    out = out.withColumn("cv_flags", F.array_join(names, "|"))
    reasons = F.array_compact(F.array(F.when(~F.col("img_ok"), F.lit("IMG_UNREADABLE")), *[F.when(F.col(f"__{a}.status") == DISAGREE, F.lit(f"DISAGREE_{a}")) for a in AXES]))
    out = out.withColumns({f"tag_{a}": F.col(f"__{a}.tag") for a in AXES} | {"review": F.size(reasons) > 0, "review_reasons": F.array_join(reasons, "|"), "context_version": F.lit(version)} | {f"p_{a}": probs[a] for a in AXES})
    return out.drop(*[f"__{a}" for a in AXES])


def fit_thresholds(df: DataFrame, v_tokens: DataFrame, classes: Mapping[str, Sequence[str]]) -> dict[str, dict[str, float]]:
    """Thresholds from the validation split alone; rows of other tokens raise. Margins fall back once when reviews are too many."""
    require_subset(df, v_tokens, message="LEAK: tokens outside V")
    margins = {a: top2_margin(F.col(f"p_{a}")) for a in AXES}
    aggs = [F.percentile(F.when(F.col("img_ok"), F.col(c)), F.lit(q)).alias(n) for n, (c, q) in FLAG_QUANTILES.items()]
    aggs += [F.percentile(m, F.array(F.lit(MARGIN_QUANTILE), F.lit(MARGIN_FALLBACK))).alias(a) for a, m in margins.items()]
    row = df.agg(*aggs).first()
    thr = {"cv": {n: float(row[n]) for n in FLAG_QUANTILES}, "margin": {a: float(row[a][0]) for a in AXES}}
    share = fuse(df, classes, thr).agg(F.avg(F.col("review").cast("double"))).first()[0]
    if share is not None and share > REVIEW_MOST:
        thr["margin"] = {a: float(row[a][1]) for a in AXES}
    return thr


def thresholds_document(thr: Mapping[str, Mapping[str, float]]) -> tuple[str, str]:
    """Sorted JSON and its sha256."""
    body = json.dumps(thr, sort_keys=True, indent=1)
    return body, hashlib.sha256(body.encode()).hexdigest()


def load_thresholds(body: str) -> dict[str, dict[str, float]]:
    thr = json.loads(body)
    if set(thr) < {"cv", "margin"} or set(FLAG_QUANTILES) - set(thr["cv"]) or set(AXES) - set(thr["margin"]):
        raise ValueError("thresholds are incomplete")
    return thr


def check_axes(axes: Mapping[str, Mapping[str, Sequence[str]]], prompts: int = 3) -> None:
    """Four axes, at least two classes each, exactly three prompts a class."""
    if set(axes) != set(AXES):
        raise ValueError(f"axes must be {', '.join(AXES)}")
    for name, classes in axes.items():
        if len(classes) < 2 or any(len(p) != prompts or not all(t.strip() for t in p) for p in classes.values()):
            raise ValueError(f"axis {name}: at least two classes with {prompts} prompts each")


def frame_context(df: DataFrame) -> DataFrame:
    """Frame tags: the front camera's if it has one, else the bad-weather majority (smallest on ties); the first known sun elevation."""
    bad = F.when(F.col("tag_weather").isNotNull() & (F.col("tag_weather") != NORMAL["weather"]), F.col("tag_weather"))
    per = df.groupBy("sample_token").agg(
        F.max(F.when(F.col("cam") == "CAM_FRONT", F.col("tag_weather"))).alias("front"), F.mode(bad, True).alias("often"), F.count(bad).alias("n_bad"),
        F.count("tag_weather").alias("n_tags"), F.min_by("sun_elev_deg", F.when(F.col("sun_elev_deg").isNotNull(), F.col("cam"))).alias("sun_elev_deg"),
    )
    return per.select("sample_token", F.coalesce("front", F.when(F.col("n_bad") * 2 > F.col("n_tags"), F.col("often")), F.lit("")).alias("weather_pred"), "sun_elev_deg")


def context_summary(df: DataFrame) -> DataFrame:
    """Distinct frames under each context; glare tags are the prefixed ones."""
    tags = {"night": F.col("tag_illum") == "night", "lowlight": F.col("tag_illum") == "lowlight", "glare": F.col("tag_glare").startswith("glare_"), "bad_lens": F.col("tag_lens") != "clean", "bad_weather": F.col("tag_weather") != "dry", "review": F.col("review")}
    return df.agg(*[F.count_distinct(F.when(c, F.col("sample_token"))).alias(n) for n, c in tags.items()])

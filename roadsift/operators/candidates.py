"""Object candidates of LiDAR frames: clusters and detector boxes in the vehicle's frame, merged, placed in the world and tracked."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import let, rotate, shift
from .matching import merge_candidates, track
from .pointcloud import CloudConfig, cluster_candidates, outside_ego

# Low x, high x, low y and high y of the vehicle's own body.
BODY = (-1.5, 3.5, -1.2, 1.2)
BOX = ("cx", "cy", "cz", "l", "w", "h", "yaw")


def wrapped(angle: Column) -> Column:
    """The same direction within (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def to_vehicle(boxes: DataFrame, calibration: DataFrame, frame: str = "sample_token") -> DataFrame:
    """Centres and yaws of sensor-frame boxes in the vehicle's frame; frames without a calibration keep theirs."""
    pose = calibration.select(frame, F.col("R").alias("__R"), F.col("t").alias("__t"))
    known = F.col("__R").isNotNull()
    met = boxes.join(pose, frame, "left").withColumn("__c", F.when(known, shift(rotate(F.col("__R"), F.array("cx", "cy", "cz")), F.col("__t"))))
    moved = {c: F.when(known, F.col("__c")[k]).otherwise(F.col(c)) for k, c in enumerate(("cx", "cy", "cz"))}
    turned = F.when(known, wrapped(F.col("yaw") + let(F.col("__R"), lambda m: F.atan2(m[3], m[0])))).otherwise(F.col("yaw"))
    return met.withColumns(moved | {"yaw": turned}).drop("__R", "__t", "__c")


def detector_candidates(
    detections: DataFrame, names: Sequence[str], groups: Mapping[str, str], calibration: DataFrame | None = None, least: float = 0.3, first_label: int = 1, frame: str = "sample_token",
) -> DataFrame:
    """Detector boxes (frame, box, label, score) of at least the score ``least`` with their class group, no points yet.

    Labels outside ``names`` and names outside ``groups`` are ``other``."""
    group = F.array(*[F.lit(groups.get(n, "other")) for n in names])
    place = F.col("label") - first_label
    cls = F.when(place.between(0, len(names) - 1), F.get(group, place.cast("int"))).otherwise(F.lit("other"))
    kept = detections.filter(F.col("score") >= least).select(frame, *[F.col(c).cast("double").alias(c) for c in BOX], F.lit(0).alias("pts"), cls.alias("cls_pred"), "score")
    moved = kept if calibration is None else to_vehicle(kept, calibration, frame)
    return moved.withColumns({"dist_m": F.hypot("cx", "cy"), "source": F.lit("detector")})


def in_world(objects: DataFrame, poses: DataFrame, frame: str = "sample_token") -> DataFrame:
    """gx, gy of vehicle-frame candidates by the frame's ego_x, ego_y and ego_yaw."""
    met = objects.join(poses.select(frame, *[F.col(c).cast("double").alias(f"__{c}") for c in ("ego_x", "ego_y", "ego_yaw")]), frame)
    c, s = F.cos("__ego_yaw"), F.sin("__ego_yaw")
    at = {"gx": F.col("__ego_x") + c * F.col("cx") - s * F.col("cy"), "gy": F.col("__ego_y") + s * F.col("cx") + c * F.col("cy")}
    return met.withColumns(at).drop("__ego_x", "__ego_y", "__ego_yaw")


def object_candidates(
    points: DataFrame, index: DataFrame, calibration: DataFrame | None = None, detections: DataFrame | None = None, names: Sequence[str] = (), groups: Mapping[str, str] | None = None,
    body: tuple[float, float, float, float] | None = BODY, least_score: float = 0.3, least_iou: float = 0.3, d_max: float = 1.5, v_max: float = 3.0, cfg: CloudConfig = CloudConfig(), frame: str = "sample_token",
) -> DataFrame:
    """Candidates of every kept frame: clusters and detector boxes outside the vehicle's body, merged by overlap, with gx, gy, track and speed.

    ``index`` has the frame, scene_token, timestamp, ego_x, ego_y, ego_yaw and keep; a
    frame without candidates has no row but ends the tracks of its scene."""
    kept = index.filter("keep")
    clusters = cluster_candidates(points.join(kept.select(frame), frame, "left_semi"), frame, cfg, calibration)
    found = detections if detections is not None else index.sparkSession.createDataFrame([], f"{frame} {index.schema[frame].dataType.simpleString()}, cx double, cy double, cz double, l double, w double, h double, yaw double, label int, score double")
    boxes = detector_candidates(found.join(kept.select(frame), frame, "left_semi"), names, groups or {}, calibration, least_score, frame=frame)
    if body:
        clusters, boxes = (x.filter(outside_ego(*body)) for x in (clusters, boxes))
    merged = in_world(merge_candidates(clusters, boxes, frame, least_iou, detections is not None), kept, frame)
    walk = kept.select("scene_token", frame, "timestamp").join(merged.select(frame, "object_id", "gx", "gy"), frame, "left")
    tracks = track(walk, "scene_token", frame, "timestamp", d_max, v_max).filter("object_id is not null").drop("scene_token")
    return merged.join(tracks, [frame, "object_id"])

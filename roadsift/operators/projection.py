"""Boxes in camera images: labels to every camera that sees them, candidates to their best camera."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import CORNERS, box_corners, let, rotate_back, rotation_matrix, shift
from ..sources.metadata import camera_place

WIDTH, HEIGHT, NEAR = 1600.0, 900.0, 0.1
_Rows = list[np.ndarray]
_HALF = np.array(CORNERS)[:, :, None] / 2


def _child(corners: Column, q: Column, t: Column) -> Column:
    """Points of an array in the frame of a pose."""
    return let(rotation_matrix(q), lambda m: F.transform(corners, lambda p: rotate_back(m, shift(p, t, -1))))


def _matrix(q: _Rows) -> _Rows:
    """``rotation_matrix`` of a batch of rows."""
    n = np.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    w, x, y, z = (v / n for v in q)
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def _corners(center: _Rows, size: _Rows, q: _Rows) -> _Rows:
    """``box_corners`` of a batch: x, y and z, eight rows each."""
    m, (w, l, h) = _matrix(q), size  # noqa: E741
    p = (l * _HALF[:, 0], w * _HALF[:, 1], h * _HALF[:, 2])
    return [m[3 * r] * p[0] + m[3 * r + 1] * p[1] + m[3 * r + 2] * p[2] + center[r] for r in range(3)]


def _within(p: _Rows, q: _Rows, t: _Rows) -> _Rows:
    """Points of a batch in the frame of a pose."""
    m, p = _matrix(q), [v - s for v, s in zip(p, t, strict=True)]
    return [m[r] * p[0] + m[3 + r] * p[1] + m[6 + r] * p[2] for r in range(3)]


def _pixels(p: _Rows, k: _Rows) -> _Rows:
    return [(k[3 * r] * p[0] + k[3 * r + 1] * p[1] + k[3 * r + 2] * p[2]) / p[2] for r in range(2)]


def _ahead(depth: np.ndarray) -> np.ndarray:
    """All corners are in front; as in Spark, no number is below NaN."""
    return ~(depth <= NEAR).any(axis=0)


def _span(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.fmin.reduce(x, axis=0), x.max(axis=0)


def _clip(x: np.ndarray, most: float) -> np.ndarray:
    return np.where(np.isnan(x), most, np.clip(x, 0.0, most))


def _labelled(*columns: pa.Array) -> pa.Array:
    """Image box, corners and depth of a label in a camera; null where the camera does not see it."""
    v = [c.to_numpy(zero_copy_only=False) for c in columns]
    place, size, turn, ego_q, ego_t, cam_q, cam_t, k = v[:3], v[3:6], v[6:10], v[10:14], v[14:17], v[17:21], v[21:24], v[24:33]
    with np.errstate(all="ignore"):
        p, centre = (_within(_within(x, ego_q, ego_t), cam_q, cam_t) for x in (_corners(place, size, turn), place))
        us, vs = _pixels(p, k)
        seen = _ahead(p[2]) & ((us >= 0) & (us < WIDTH) & (vs >= 0) & (vs < HEIGHT)).any(axis=0)
        (x1, x2), (y1, y2) = _span(us), _span(vs)
    n = len(seen)
    corners = pa.ListArray.from_arrays(pa.array(16 * np.arange(n + 1, dtype=np.int32)), pa.array(np.stack([us, vs], axis=1).transpose(2, 0, 1).ravel()))
    values = [*(pa.array(_clip(x, most)) for x, most in ((x1, WIDTH), (y1, HEIGHT), (x2, WIDTH), (y2, HEIGHT))), corners, pa.array(centre[2])]
    return pa.StructArray.from_arrays(values, names=["x1", "y1", "x2", "y2", "corners", "depth"], mask=pa.array(~seen))


def _candidate(*columns: pa.Array) -> pa.Array:
    """Image box of a candidate in a camera and the area of its whole projection; null unless all corners are in front."""
    v = [c.to_numpy(zero_copy_only=False) for c in columns]
    none = np.zeros(len(v[0]))
    with np.errstate(all="ignore"):
        p = _within(_corners(v[:3], v[3:6], [v[6], none, none, v[7]]), v[8:12], v[12:15])
        us, vs = _pixels(p, v[15:24])
        (x1, x2), (y1, y2) = _span(us), _span(vs)
        values = [_clip(x1, WIDTH), _clip(y1, HEIGHT), _clip(x2, WIDTH), _clip(y2, HEIGHT), (x2 - x1) * (y2 - y1)]
    return pa.StructArray.from_arrays([pa.array(x) for x in values], names=["x1", "y1", "x2", "y2", "whole"], mask=pa.array(~_ahead(p[2])))


def _parts(name: str, n: int) -> list[Column]:
    return [F.col(name)[i].cast("double") for i in range(n)]


def _seen(met: DataFrame, of: Callable[..., pa.Array], kind: str, values: list[Column]) -> DataFrame:
    """Rows without a missing number with the result ``p`` of a batch function, where it has one."""
    names = [f"__v{i}" for i in range(len(values))]
    whole = met.select("*", *[v.alias(n) for v, n in zip(values, names, strict=True)]).filter(" and ".join(f"{n} is not null" for n in names))
    # not deterministic, so that the filter does not run the function a second time
    return whole.withColumn("p", F.arrow_udf(of, kind).asNondeterministic()(*names)).drop(*names).filter("p is not null")


def project_boxes(boxes: DataFrame, cameras: DataFrame) -> DataFrame:
    """2-D boxes of global 3-D boxes for every camera with all corners in front and one inside the image.

    boxes: sample_token, ann_token, category, translation, size (w, l, h), rotation, visibility,
    num_lidar_pts; cameras: sample_token, cam, ego_q, ego_t, translation, rotation, intrinsic.
    Both sides grow with the recording, so neither is broadcast."""
    cams = cameras.select("sample_token", "cam", "ego_q", "ego_t", F.col("translation").alias("cam_t"), F.col("rotation").alias("cam_q"), "intrinsic")
    met = boxes.join(cams.hint("merge"), "sample_token")
    values = [*_parts("translation", 3), *_parts("size", 3), *_parts("rotation", 4), *_parts("ego_q", 4), *_parts("ego_t", 3), *_parts("cam_q", 4), *_parts("cam_t", 3), *_parts("intrinsic", 9)]
    return _seen(met, _labelled, "struct<x1: double, y1: double, x2: double, y2: double, corners: array<double>, depth: double>", values).select("sample_token", "cam", "ann_token", "category", *[F.col("p")[c].alias(c) for c in ("x1", "y1", "x2", "y2", "corners", "depth")], "visibility", "num_lidar_pts")


def boxes_in_ego(boxes: DataFrame, egos: DataFrame) -> DataFrame:
    """Eight corners of every box, flat, in the ego frame of its sample's LiDAR."""
    met = boxes.join(egos.select("sample_token", "ego_q", "ego_t").hint("merge"), "sample_token")
    return met.select("sample_token", "ann_token", "category", F.flatten(_child(box_corners(F.col("translation"), F.col("size"), F.col("rotation")), F.col("ego_q"), F.col("ego_t"))).alias("corners"))


def project_objects(objects: DataFrame, poses: DataFrame, least_visible: float = 0.3) -> DataFrame:
    """The camera that sees most of each ego-frame candidate (to nine decimals; first camera on ties), its clipped box and the visible share."""
    half = F.col("yaw") / 2
    met = objects.join(poses.select("sample_token", "cam", "translation", "rotation", "intrinsic").hint("merge"), "sample_token")
    values = [*[F.col(c).cast("double") for c in ("cx", "cy", "cz", "w", "l", "h")], F.cos(half), F.sin(half), *_parts("rotation", 4), *_parts("translation", 3), *_parts("intrinsic", 9)]
    met = _seen(met, _candidate, "struct<x1: double, y1: double, x2: double, y2: double, whole: double>", values).select("sample_token", "object_id", "cam", "p.*")
    met = met.withColumn("visible_frac", F.try_divide((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), F.col("whole")))
    best = F.max(F.struct(F.round("visible_frac", 9).alias("r"), (-camera_place("cam")).alias("o"), "cam", "x1", "y1", "x2", "y2", "visible_frac")).alias("b")
    out = met.filter(F.col("visible_frac") > 0).groupBy("sample_token", "object_id").agg(best).filter(F.col("b.visible_frac") >= least_visible)
    return out.select("sample_token", "object_id", *[F.col(f"b.{c}").alias(c) for c in ("cam", "x1", "y1", "x2", "y2", "visible_frac")])

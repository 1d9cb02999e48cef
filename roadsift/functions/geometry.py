"""Geometry expressions: quaternions (w, x, y, z), boxes, poses, pinhole projection, IoU."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs of a box's corners along length, width and height.
CORNERS = ((1, 1, 1), (1, -1, 1), (1, -1, -1), (1, 1, -1), (-1, 1, 1), (-1, -1, 1), (-1, -1, -1), (-1, 1, -1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: keeps nested expressions linear in size."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit_quaternion(q: Column) -> Column:
    return let(q, lambda q: let(F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3]), lambda n: F.transform(q, lambda x: x / n)))


def rotation_matrix(q: Column) -> Column:
    """Row-major 3 x 3 rotation of a quaternion, which is normalised first."""

    def matrix(u: Column) -> Column:
        w, x, y, z = (u[i] for i in range(4))
        return F.array(
            1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
            2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
            2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
        )

    return let(unit_quaternion(q), matrix)


def yaw(q: Column) -> Column:
    return let(q, lambda q: F.atan2(2 * (q[0] * q[3] + q[1] * q[2]), 1 - 2 * (q[2] * q[2] + q[3] * q[3])))


def quaternion_product(a: Column, b: Column) -> Column:
    def product(a: Column, b: Column) -> Column:
        aw, ax, ay, az = (a[i] for i in range(4))
        bw, bx, by, bz = (b[i] for i in range(4))
        return F.array(
            aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by,
            aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw,
        )

    return let(a, lambda a: let(b, lambda b: product(a, b)))


def conjugate(q: Column) -> Column:
    return let(q, lambda q: F.array(q[0], -q[1], -q[2], -q[3]))


def rotate(m: Column, p: Column) -> Column:
    return let(m, lambda m: let(p, lambda p: F.array(*[m[3 * r] * p[0] + m[3 * r + 1] * p[1] + m[3 * r + 2] * p[2] for r in range(3)])))


def rotate_back(m: Column, p: Column) -> Column:
    """Transposed rotation."""
    return let(m, lambda m: let(p, lambda p: F.array(*[m[r] * p[0] + m[3 + r] * p[1] + m[6 + r] * p[2] for r in range(3)])))


def shift(p: Column, t: Column, sign: int = 1) -> Column:
    return F.zip_with(p, t, lambda x, y: x + sign * y)


def to_parent(p: Column, q: Column, t: Column) -> Column:
    """Sensor to ego, or ego to global."""
    return shift(rotate(rotation_matrix(q), p), t)


def to_child(p: Column, q: Column, t: Column) -> Column:
    """Global to ego, or ego to camera."""
    return rotate_back(rotation_matrix(q), shift(p, t, -1))


def relative_pose(parent_q: Column, parent_t: Column, child_q: Column, child_t: Column) -> tuple[Column, Column]:
    """Rotation and translation of the child in the parent's frame."""
    return quaternion_product(conjugate(parent_q), child_q), rotate_back(rotation_matrix(parent_q), shift(child_t, parent_t, -1))


def box_corners(center: Column, size_wlh: Column, q: Column) -> Column:
    """Eight corners as an array of (x, y, z): front face first, upper left corner first, clockwise."""
    half = F.array(*[F.array(F.lit(sx / 2), F.lit(sy / 2), F.lit(sz / 2)) for sx, sy, sz in CORNERS])
    return let(rotation_matrix(q), lambda m: let(size_wlh, lambda s: F.transform(half, lambda k: shift(rotate(m, F.array(s[1] * k[0], s[0] * k[1], s[2] * k[2])), center))))


def pixel(p: Column, intrinsic: Column) -> Column:
    """(u, v, depth) of a camera-frame point; u and v are null at depth 0."""
    return let(p, lambda p: let(intrinsic, lambda k: F.array(*[F.try_divide(k[3 * r] * p[0] + k[3 * r + 1] * p[1] + k[3 * r + 2] * p[2], p[2]) for r in range(2)], p[2])))


def iou(a: list[Column], b: list[Column]) -> Column:
    """IoU of axis-aligned boxes given as x1, y1, x2, y2."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / F.greatest(union, F.lit(1e-9))


def bev_iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """IoU of boxes given as centre and side lengths, sides taken as axis aligned."""
    corners = lambda c: [c[0] - c[2] / 2, c[1] - c[3] / 2, c[0] + c[2] / 2, c[1] + c[3] / 2]
    return iou(corners(a), corners(b))


def principal_yaw(var_x: Column, var_y: Column, cov: Column) -> Column:
    """Main axis of a planar point set, modulo pi."""
    return 0.5 * F.atan2(2 * cov, var_x - var_y)


def angle_error(a: Column, b: Column, period: float = math.pi) -> Column:
    """Smallest difference of two angles modulo ``period``."""
    d = F.pmod(a - b, F.lit(period))
    return F.least(d, F.lit(period) - d)


def in_rectangle(x: Column, y: Column, low_x: float, high_x: float, low_y: float, high_y: float) -> Column:
    return x.between(low_x, high_x) & y.between(low_y, high_y)


def in_rotated_box(p: Column, center: Column, size_wlh: Column, q: Column, slack: float = 1e-6) -> Column:
    inside = lambda v: (F.abs(v[0]) <= size_wlh[1] / 2 + slack) & (F.abs(v[1]) <= size_wlh[0] / 2 + slack) & (F.abs(v[2]) <= size_wlh[2] / 2 + slack)
    return let(rotate_back(rotation_matrix(q), shift(p, center, -1)), inside)

"""Pictures as rows: top-view rasters and thumbnails as PNG, made in Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def png(image: np.ndarray) -> bytes:
    """A PNG of 8-bit grey (rows x columns) or RGB (rows x columns x 3) values, every row with the difference to the row above (filter 2)."""
    image = np.ascontiguousarray(image, np.uint8)
    height, width = image.shape[:2]
    rows = image.reshape(height, -1)
    up = np.vstack([rows[:1], rows[1:] - rows[:-1]]) if height else rows
    raw = np.column_stack([np.full(height, 2, np.uint8), up]).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def shrunk(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means of an image at a smaller size (each target pixel is the mean of the source area it covers); never enlarged, proportions kept."""
    scale = min(1.0, height / image.shape[0], width / image.shape[1])
    target = max(1, round(image.shape[0] * scale)), max(1, round(image.shape[1] * scale))
    out = image.astype(np.float64)
    for axis, n in enumerate(target):
        size = out.shape[axis]
        sums = np.concatenate([np.zeros_like(out.take([0], axis)), np.cumsum(out, axis=axis)], axis=axis)
        edges = np.linspace(0, size, n + 1)
        low = np.minimum(np.floor(edges).astype(int), size)
        part = np.expand_dims(edges - low, tuple(k for k in range(out.ndim) if k != axis))
        at = sums.take(low, axis) + part * (sums.take(np.minimum(low + 1, size), axis) - sums.take(low, axis))
        out = np.diff(at, axis=axis) / (size / n)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def top_view(points: DataFrame, key: str, x: str, y: str, pixels: int, half: float, out: str = "png") -> DataFrame:
    """key, png: the log point density of each frame's square around the vehicle, ahead up and left to the left.

    Points are counted by cell first, so a frame's picture is made from at most
    pixels x pixels rows; points outside the square count for nothing."""
    cell = lambda c: F.floor((F.col(c) + half) * F.lit(pixels / (2 * half))).cast("int")
    inside = points.filter((F.col(x) >= -half) & (F.col(x) < half) & (F.col(y) >= -half) & (F.col(y) < half))
    counts = inside.groupBy(key, cell(x).alias("ix"), cell(y).alias("iy")).agg(F.count(F.lit(1)).alias("n"))
    return density_png(counts, key, "ix", "iy", "n", pixels, out)


def density_png(counts: DataFrame, key: str, ix: str, iy: str, n: str, pixels: int, out: str = "png") -> DataFrame:
    """Cell counts as pictures: 255 log(1 + n) / log(1 + most), rows by falling x, columns by falling y."""
    schema = T.StructType([T.StructField(key, counts.schema[key].dataType), T.StructField(out, T.BinaryType())])

    def draw(g: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((pixels, pixels))
        grid[g[ix].to_numpy(), g[iy].to_numpy()] = g[n].to_numpy()
        shade = np.log1p(grid)
        grey = (255 * shade / max(shade.max(), 1e-6)).astype(np.uint8)
        return pd.DataFrame({key: [g[key].iloc[0]], out: [png(grey[::-1, ::-1])]})

    return counts.select(key, ix, iy, n).groupBy(key).applyInPandas(draw, schema)


def thumbnails(images: DataFrame, key: str, pixels: str, height: str, width: str, existing: DataFrame | None = None, size: tuple[int, int] = (180, 320), out: str = "png") -> DataFrame:
    """key, png of decoded images (bytes of rows x columns x 3 values with their height and width).

    Keys in ``existing`` are left out before any pixel is read; an image whose bytes do not
    fit its size, or that is empty, gives a null picture."""
    todo = images if existing is None else images.join(existing.select(key).distinct(), key, "left_anti")
    schema = T.StructType([T.StructField(key, images.schema[key].dataType), T.StructField(out, T.BinaryType())])

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for body, h, w in zip(b[pixels], b[height], b[width], strict=True):
                good = body is not None and h > 0 and w > 0 and len(body) == h * w * 3
                made.append(png(shrunk(np.frombuffer(body, np.uint8).reshape(int(h), int(w), 3), *size)) if good else None)
            yield pd.DataFrame({key: b[key], out: made})

    return todo.select(key, pixels, height, width).mapInPandas(make, schema)


def is_png(column: Column) -> Column:
    return F.substring(column, 1, 8) == F.lit(SIGNATURE)

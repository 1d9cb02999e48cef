"""Model adapters: anything that encodes texts or images plugs in here; deterministic stand-ins serve tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class TextEncoder(Protocol):
    def encode(self, texts: Sequence[str]) -> np.ndarray:
        """An L2-normalised row for each text."""
        ...


def seeded_vector(key: str, width: int, salt: str = "") -> np.ndarray:
    """A unit vector from the sha256 of a key."""
    seed = int.from_bytes(hashlib.sha256(f"{salt}|{key}".encode()).digest()[:8], "little")
    v = np.random.default_rng(seed).standard_normal(width)
    return v / np.linalg.norm(v)


class HashEncoder:
    def __init__(self, width: int = 32, salt: str = "text"):
        self.width, self.salt = width, salt

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        return np.stack([seeded_vector(t, self.width, self.salt) for t in texts]) if texts else np.empty((0, self.width))


class CachedEncoder:
    """Keeps the last few query sets by the sha1 of their texts."""

    def __init__(self, encoder: TextEncoder, most: int = 32):
        self.encoder, self.most = encoder, most
        self.kept: dict[str, np.ndarray] = {}

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        if not texts:
            raise ValueError("at least one query is needed")
        key = hashlib.sha1("\n".join(texts).encode()).hexdigest()
        if key in self.kept:
            self.kept[key] = self.kept.pop(key)
        else:
            self.kept[key] = self.encoder.encode(texts)
            while len(self.kept) > self.most:
                self.kept.pop(next(iter(self.kept)))
        return self.kept[key]


def class_vectors(encoder: TextEncoder, prompts: dict[str, Sequence[str]]) -> dict[str, np.ndarray]:
    """Mean of each class's prompt vectors, normalised."""
    out = {}
    for name, texts in prompts.items():
        v = encoder.encode(list(texts)).mean(0)
        out[name] = v / max(float(np.linalg.norm(v)), 1e-12)
    return out


def embed_images(df: DataFrame, key: Sequence[str], path: str, model: Callable[[Sequence[str]], np.ndarray] | None = None, width: int = 32, batch: int = 64) -> DataFrame:
    """``key`` and ``embedding`` by any batch model (paths to vectors); a batch that runs out of memory is halved."""
    model = model or (lambda paths: np.stack([seeded_vector(p, width, "image") for p in paths]))
    schema = T.StructType([*[df.schema[c] for c in key], T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(paths: list[str]) -> list[np.ndarray]:
        try:
            return list(model(paths))
        except MemoryError:
            if len(paths) < 2:
                raise
            return run(paths[: len(paths) // 2]) + run(paths[len(paths) // 2 :])

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[np.ndarray] = []
            for a in range(0, len(b), batch):
                out += run(b[path].iloc[a : a + batch].tolist())
            yield b[list(key)].assign(embedding=[v.astype(np.float32) for v in out])

    return df.select(*key, path).mapInPandas(embed, schema)


def detect(df: DataFrame, key: Sequence[str], path: str, predictor: Callable[[Sequence[str]], list[np.ndarray]] | None = None, batch: int = 64) -> DataFrame:
    """``key``, cls, conf and box of every detection of an injected predictor (paths to n x 6 arrays: x1, y1, x2, y2, conf, cls)."""

    def stand_in(paths: Sequence[str]) -> list[np.ndarray]:
        out = []
        for p in paths:
            rng = np.random.default_rng(int.from_bytes(hashlib.sha256(p.encode()).digest()[:8], "little"))
            n = int(rng.integers(0, 6))
            xy, wh = rng.uniform(0, 1200, (n, 2)), rng.uniform(20, 300, (n, 2))
            out.append(np.column_stack([xy, xy + wh, rng.uniform(0, 1, n), rng.integers(0, 10, n)]) if n else np.empty((0, 6)))
        return out

    predictor = predictor or stand_in
    fields = [T.StructField("cls", T.ShortType()), *[T.StructField(c, T.FloatType()) for c in ("conf", "x1", "y1", "x2", "y2")]]
    schema = T.StructType([*[df.schema[c] for c in key], *fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), batch):
                part = b.iloc[a : a + batch]
                found = predictor(part[path].tolist())
                n = [len(f) for f in found]
                m = np.concatenate(found) if found else np.empty((0, 6))
                keys = part[list(key)].loc[part.index.repeat(n)].reset_index(drop=True)
                yield keys.assign(cls=m[:, 5].astype(np.int16), conf=m[:, 4].astype(np.float32), **{c: m[:, k].astype(np.float32) for k, c in enumerate(("x1", "y1", "x2", "y2"))})

    return df.select(*key, path).mapInPandas(run, schema)


def image_quality(gray: np.ndarray) -> tuple[float, float]:
    """Mean luma and the variance of the 3 x 3 Laplacian of a decoded grey image."""
    g = gray.astype(np.float64)
    if g.shape[0] < 3 or g.shape[1] < 3:
        return float(g.mean()) if g.size else 0.0, 0.0
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(g.mean()), float(lap.var())


#: Size at which features are taken (columns, rows), brightness from which a pixel is saturated, and the least blob.
FEATURE_SIZE, SATURATED, LEAST_BLOB = (448, 252), 250, 20
# 5-tap Gaussian of sigma 1, Laplacian, and the noise mask.
_GAUSS = np.exp(-np.arange(-2.0, 3.0) ** 2 / 2) / np.exp(-np.arange(-2.0, 3.0) ** 2 / 2).sum()
_LAPLACE = np.asarray([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float)
_NOISE = np.asarray([[1, -2, 1], [-2, 4, -2], [1, -2, 1]], float)


def _shares(n: int, m: int) -> np.ndarray:
    """m x n weights that average n cells to m by area."""
    low, high = np.arange(m)[:, None] * n / m, (np.arange(m)[:, None] + 1) * n / m
    cell = np.arange(n)[None]
    return np.clip(np.minimum(high, cell + 1) - np.maximum(low, cell), 0, None) * m / n


def _filtered(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Correlation with the image mirrored at its edge rows and columns."""
    a, b = mask.shape[0] // 2, mask.shape[1] // 2
    wide = np.pad(image, ((a, a), (b, b)), mode="reflect")
    return sum(w * wide[i : i + image.shape[0], j : j + image.shape[1]] for (i, j), w in np.ndenumerate(mask) if w)


def image_features(image: np.ndarray) -> dict[str, float]:
    """The 13 quality features of a decoded image (rows x columns, or x 3 colours R, G, B; 0 to 255), taken at FEATURE_SIZE.

    Brightness is the largest colour, grey the usual weighted mean.  A black image has
    veil and sharpness 0; sharpness is the Laplacian's variance after a blur, over the
    squared noise."""
    image = np.asarray(image, np.float64)
    colours = image if image.ndim == 3 else np.repeat(image[:, :, None], 3, axis=2)
    columns, rows = FEATURE_SIZE
    if colours.shape[:2] != (rows, columns):
        down, across = _shares(colours.shape[0], rows), _shares(colours.shape[1], columns)
        colours = np.rint(np.stack([down @ colours[:, :, k] @ across.T for k in range(3)], axis=2))
    grey, v = np.rint(colours @ [0.299, 0.587, 0.114]), colours.max(axis=2)
    reached = np.cumsum(np.bincount(v.astype(np.int64).ravel(), minlength=256))
    p5, p95 = (int(np.searchsorted(reached, q * v.size)) for q in (0.05, 0.95))
    bright = v >= SATURATED
    blobs = blob_sizes(_dilate(bright)) if bright.any() else []
    tiles = grey.reshape(4, rows // 4, 4, columns // 4).mean(axis=(1, 3))
    noise = float(np.sqrt(np.pi / 2) * np.abs(_filtered(grey, _NOISE)[1:-1, 1:-1]).sum() / (6 * (columns - 2) * (rows - 2)))
    blurred = np.rint(_filtered(_filtered(grey, _GAUSS[:, None]), _GAUSS[None]))
    sharp = float(_filtered(blurred, _LAPLACE).var())
    return {
        "luma_mean": float(grey.mean()), "v_mean": float(v.mean()), "v_p5": float(p5), "v_p95": float(p95), "sat_frac": float(bright.mean()), "blob_max_frac": max(blobs, default=0) / v.size,
        "blob_count": sum(n >= LEAST_BLOB for n in blobs), "tile_range": float(tiles.max() - tiles.min()), "veil": p5 / max(p95, 1) if p95 else 0.0, "noise_sigma": noise,
        "lap_var_raw": float(_filtered(grey, _LAPLACE).var()), "lap_var_dn": sharp, "sharp_ratio": sharp / max(noise**2, 1e-6) if p95 else 0.0,
    }


def _dilate(mask: np.ndarray) -> np.ndarray:
    k = np.pad(mask, 1)
    return np.logical_or.reduce([k[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3)])


def blob_sizes(mask: np.ndarray) -> list[int]:
    """Sizes of 8-connected blobs."""
    left, out = {tuple(p) for p in np.argwhere(mask)}, []
    while left:
        stack, n = [left.pop()], 0
        while stack:
            i, j = stack.pop()
            n += 1
            for p in ((i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if p in left:
                    left.discard(p)
                    stack.append(p)
        out.append(n)
    return out

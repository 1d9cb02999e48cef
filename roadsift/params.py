"""Selection parameters: presets, budgets, resolution."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from .schemas import CAMERAS

# Weights of novelty (rarity), uncertainty (novelty) and query (uncertainty) by preset.
CAMERA_PRESETS = {"balanced": (0.4, 0.3, 0.3), "rare_first": (0.6, 0.2, 0.2), "hard_for_model": (0.2, 0.6, 0.2), "safety_scenarios": (0.2, 0.2, 0.6)}
LIDAR_PRESETS = {"balanced": (0.5, 0.25, 0.25), "rare_first": (0.8, 0.1, 0.1), "hard_for_model": (0.2, 0.3, 0.5), "safety_scenarios": (0.6, 0.0, 0.4)}
DIVERSITY = {"low": 0.9, "medium": 0.7, "high": 0.5}
BUDGET_MIN, BUDGET_MAX = 0.01, 0.10


class ParameterError(ValueError):
    """Parameters that cannot be resolved."""


@dataclass(frozen=True)
class Selection:
    budget: float
    weights: tuple[float, float, float]
    lam: float
    per_scene: int | None
    min_gap: int = 1
    k: int = 10
    tier: int = 0
    cameras: tuple[str, ...] = CAMERAS
    min_luma: float = 8.0
    min_blur_var: float = 15.0


def budget_frames(n: int, fraction: float, floor: bool = True) -> int:
    """ceil(fraction * n) with a guard against binary fractions; at least 1 where ``floor`` holds and rows exist."""
    b = math.ceil(round(fraction * n, 9))
    return max(1, b) if floor and n else b


def clamp_budget(budget: float, most: float = BUDGET_MAX) -> float:
    return min(max(budget, BUDGET_MIN), most)


def check_budget(budget: float) -> float:
    if not BUDGET_MIN <= budget <= BUDGET_MAX:
        raise ParameterError(f"budget must lie in [{BUDGET_MIN}, {BUDGET_MAX}]")
    return budget


@dataclass(frozen=True)
class Field:
    """A parameter: its kind, range, step and default (None: given by preset or diversity)."""

    kind: str
    low: float | None = None
    high: float | None = None
    step: float | None = None
    default: object = None
    display: str = ""
    group: str = ""

    def check(self, name: str, value: float) -> None:
        if (self.low is not None and value < self.low) or (self.high is not None and value > self.high):
            raise ParameterError(f"{name} must lie in [{self.low}, {self.high}]")


LIDAR_FIELDS = {
    "tier": Field("int", 0, 1, 1, None, "choice"),
    "k": Field("int", 3, 50, 1, 10, "count"),
    "lam": Field("float", 0, 1, 0.05, DIVERSITY["medium"], "percent"),
    "maxPerScene": Field("int", 1, 50, 1, 4, "count"),
    "quotaOff": Field("bool", default=False, display="toggle"),
    "alpha": Field("float", 0, 1, 0.05, 1.0, "percent", "weights"),
    "beta": Field("float", 0, 1, 0.05, 0.0, "percent", "weights"),
    "gamma": Field("float", 0, 1, 0.05, 0.0, "percent", "weights"),
}


def params_schema(tiers: Sequence[int] = (0,)) -> dict[str, object]:
    """Fields with kind, range, step and default, the weights' group, the tiers there are and the presets."""
    shown = [{"key": name, "type": f.kind, "min": f.low, "max": f.high, "step": f.step, "default": max(tiers) if name == "tier" else f.default, "display": f.display} | ({"group": f.group} if f.group else {}) for name, f in LIDAR_FIELDS.items()]
    return {"fields": shown, "groups": sorted({f.group for f in LIDAR_FIELDS.values() if f.group}), "tierAvailable": list(tiers), "presets": {name: list(w) for name, w in LIDAR_PRESETS.items()}}


def _known(table: Mapping[str, object], kind: str, name: str) -> object:
    if name not in table:
        raise ParameterError(f"unknown {kind}: {name}")
    return table[name]


def _shares(asked: Sequence[float | None], otherwise: tuple[float, ...]) -> tuple[float, ...]:
    """Weights that sum to 1: those asked for, a missing one being 0, or else the given ones."""
    if set(asked) == {None}:
        return otherwise
    filled = tuple(x or 0.0 for x in asked)
    total = math.fsum(filled)
    if total <= 0 or any(x < 0 for x in filled):
        raise ParameterError("weights must not be negative and must have a positive sum")
    return tuple(x / total for x in filled)


def resolve_camera(
    budget: float = 0.05, preset: str = "balanced", diversity: str = "medium", alpha: float | None = None, beta: float | None = None, gamma: float | None = None,
    max_per_scene: int | None = None, min_gap: int | None = None, cameras: Sequence[str] | None = None, min_luma: float | None = None, min_blur_var: float | None = None,
) -> Selection:
    chosen = tuple(c for c in CAMERAS if c in (cameras or CAMERAS))
    if not chosen:
        raise ParameterError("at least one camera is needed")
    weights = _shares((alpha, beta, gamma), _known(CAMERA_PRESETS, "preset", preset))  # type: ignore[arg-type]
    light = {name: value for name, value in (("min_luma", min_luma), ("min_blur_var", min_blur_var)) if value is not None}
    return Selection(clamp_budget(budget), weights, _known(DIVERSITY, "diversity", diversity), max_per_scene or 4, min_gap or 4, cameras=chosen, **light)  # type: ignore[arg-type]


def resolve_lidar(
    budget: float = 0.05, preset: str = "balanced", diversity: str = "medium", tier: int | None = None, k: int | None = None, lam: float | None = None, max_per_scene: int | None = None,
    quota_off: bool = False, alpha: float | None = None, beta: float | None = None, gamma: float | None = None, tiers: Sequence[int] = (0,),
) -> tuple[Selection, list[str]]:
    """Tier 0 has geometry only: whatever weights are asked for become (1, 0, 0), with a warning if others had a share."""
    values = {"tier": max(tiers) if tier is None else tier, "k": LIDAR_FIELDS["k"].default if k is None else k, "lam": _known(DIVERSITY, "diversity", diversity) if lam is None else lam}
    for name, value in values.items():
        LIDAR_FIELDS[name].check(name, value)  # type: ignore[arg-type]
    if values["tier"] not in tiers:
        raise ParameterError(f"tier {values['tier']} is not available")
    geometry = (1.0, 0.0, 0.0)
    preset_weights = _known(LIDAR_PRESETS, "preset", preset)
    weights = _shares((alpha, beta, gamma), preset_weights if values["tier"] else geometry)  # type: ignore[arg-type]
    warnings = []
    if not values["tier"] and weights != geometry:
        weights, warnings = geometry, ["tier 0 uses rarity only: the other weights are set to 0"]
    quota = None if quota_off else max_per_scene or LIDAR_FIELDS["maxPerScene"].default
    return Selection(clamp_budget(budget), weights, values["lam"], quota, k=values["k"], tier=values["tier"]), warnings  # type: ignore[arg-type]


def without_novelty(weights: tuple[float, float, float]) -> tuple[tuple[float, float, float], list[str]]:
    """Weights when the novelty source is missing: beta is dropped, the others are normalised again."""
    a, b, g = weights
    if not b:
        return weights, []
    total = a + g
    return ((a / total, 0.0, g / total) if total else (1.0, 0.0, 0.0)), ["novelty has no source: its weight is set to 0"]


def selection_id(params: Selection | Mapping[str, object], inputs: Sequence[tuple[str, int, int]]) -> str:
    """12 hex digits of parameters and input fingerprints (name, size, modification time)."""
    body = asdict(params) if isinstance(params, Selection) else dict(params)
    return hashlib.sha1(json.dumps([body, sorted(inputs)], sort_keys=True, default=str).encode()).hexdigest()[:12]


def overlay(base: Mapping[str, object], profile: Mapping[str, object]) -> dict[str, object]:
    """Recursive dictionary merge, the profile over the base."""
    out = dict(base)
    for k, v in profile.items():
        old = out.get(k)
        out[k] = overlay(old, v) if isinstance(old, Mapping) and isinstance(v, Mapping) else v
    return out

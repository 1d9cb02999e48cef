"""Scalar expressions: entropy, bins, strings, JSON, time."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def binary_entropy(p: Column, bits: bool = True) -> Column:
    """Entropy of a confidence clipped to [1e-6, 1 - 1e-6], in bits or nats."""
    q = F.least(F.greatest(p.cast("double"), F.lit(EPS)), F.lit(1 - EPS))
    nats = -(q * F.ln(q) + (1 - q) * F.ln(1 - q))
    return nats / math.log(2) if bits else nats


def relative_change(now: Column, before: Column) -> Column:
    """|now - before| / max(now, before, 1)."""
    return F.abs(now - before) / F.greatest(now, before, F.lit(1.0))


def surprisal(p: Column) -> Column:
    """-ln p; unseen (null or zero) is infinite."""
    return F.when(p > 0, -F.ln(p)).otherwise(F.lit(float("inf")))


def shape_score(deviations: Sequence[Column]) -> Column:
    """1 - exp(-max z^2 / 2) over the z scores of box sides."""
    squares = [d * d for d in deviations]
    return 1 - F.exp(-0.5 * (F.greatest(*squares) if len(squares) > 1 else squares[0]))


def bin_right(x: Column, edges: Sequence[float] | Column, clip: bool = False) -> Column:
    """Number of edges at or below x (a right-sided sorted search); clipped to the inner bins on demand."""
    array = edges if isinstance(edges, Column) else F.array(*[F.lit(float(e)) for e in edges])
    place = F.size(F.filter(array, lambda e: e <= x))
    return F.least(F.greatest(place - 1, F.lit(0)), F.size(array) - 2) if clip else place


def bin_left(x: Column, edges: Sequence[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < x))


def equal_width_bin(x: Column, bins: int, low: float = 0.0, high: float = 1.0) -> Column:
    """1-based bin; the last bin is closed on the right; null outside the range."""
    place = F.least(F.floor((x - low) / (high - low) * bins) + 1, F.lit(bins)).cast("int")
    return F.when((x >= low) & (x <= high), place)


def size_class(length: Column, width: Column, height: Column, rules: Sequence[tuple[str, float, float, float, float]], other: str = "other") -> Column:
    """First rule (name, longest side, longest shorter side, least height, most height) that holds; ``other`` if none does."""
    longer, shorter = F.greatest(length, width), F.least(length, width)
    out: Column | None = None
    for name, most_l, most_w, least_h, most_h in rules:
        cond = (longer <= most_l) & (shorter <= most_w) & height.between(least_h, most_h)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(other)) if out is not None else F.lit(other)


def has_keyword(text: Column, words: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def starts_with_any(text: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.coalesce(text.startswith(p), F.lit(False))
    return out


def slug(text: Column, fallback: str = "query", length: int = 32) -> Column:
    """Lower case, runs of other characters as one underscore, trimmed, cut, never empty."""
    plain = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, length)
    return F.when(F.length(plain) > 0, plain).otherwise(F.lit(fallback))


def pipe_join(items: Column) -> Column:
    return F.array_join(items, "|")


def pipe_split(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda x: x != "")


def tag_matches(tags: Column, term: str) -> Column:
    """Whether any tag is the term or starts with it."""
    return F.exists(tags, lambda t: t.startswith(term))


def tags_from(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of the rules that hold, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))


def cell_key(kind: Column, distance_bin: Column, points_bin: Column) -> Column:
    return F.concat(kind, F.lit("|d"), distance_bin.cast("string"), F.lit("|p"), points_bin.cast("string"))


def top_reasons(parts: Sequence[tuple[str, Column]], least: float = 0.8, most: int = 2, fallback: str = "balanced candidate", rounded: bool = False) -> Column:
    """The strongest components at or above ``least`` as "name pNN", joined by a middle dot."""
    show = (lambda v: F.bround(v * 100).cast("int")) if rounded else (lambda v: F.floor(v * 100 + 1e-9).cast("int"))
    items = F.array(*[F.when(v >= least, F.struct((-v).alias("k"), F.lit(i).alias("i"), F.concat(F.lit(f"{name} p"), show(v).cast("string")).alias("t"))) for i, (name, v) in enumerate(parts)])
    best = F.slice(F.array_sort(F.array_compact(items)), 1, most)
    return F.when(F.size(best) > 0, F.array_join(F.transform(best, lambda s: s["t"]), " · ")).otherwise(F.lit(fallback))


def arg_max_reason(parts: Sequence[tuple[str, Column]]) -> Column:
    """The first largest component as "name pNN" (rounded half to even)."""
    best = F.greatest(*[v for _, v in parts]) if len(parts) > 1 else parts[0][1]
    out: Column | None = None
    for name, v in parts:
        text = F.concat(F.lit(f"{name} p"), F.bround(v * 100).cast("int").cast("string"))
        out = F.when(v == best, text) if out is None else out.when(v == best, text)
    return out if out is not None else F.lit(None).cast("string")


def softmax(x: Column) -> Column:
    shifted = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, v: a + v)
    return F.transform(shifted, lambda v: v / total)


def top2_margin(p: Column) -> Column:
    ranked = F.sort_array(p, asc=False)
    return ranked[0] - ranked[1]


def arg_max(p: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def lookup(key: Column, table: Mapping[str, str], default: str | None = None) -> Column:
    mapped = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key] if table else F.lit(None).cast("string")
    return F.coalesce(mapped, F.lit(default)) if default is not None else mapped


def json_probs(names: Sequence[str], values: Sequence[Column]) -> Column:
    return F.to_json(F.struct(*[F.bround(v, 6).alias(n) for n, v in zip(names, values, strict=True)]))


def json_field(doc: Column, path: str) -> Column:
    """A JSON value as text; malformed documents give null."""
    return F.get_json_object(doc, path)


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def parse_size(text: Column) -> Column:
    """Bytes of a size such as 50MB or 1.5 GB."""
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1).cast("double")
    unit = F.upper(F.regexp_extract(text, r"([KMGT]?)i?B?\s*$", 1))
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return (number * F.pow(F.lit(1024.0), power)).cast("long")


def scene_range(spec: Column, width: int = 4, prefix: str = "scene-") -> Column:
    """Names meant by "3..7,12": an array, in the order written."""
    parts = F.transform(F.split(F.regexp_replace(spec, r"\s", ""), ","), lambda p: F.when(p.contains(".."), F.sequence(F.try_element_at(F.split(p, r"\.\."), F.lit(1)).try_cast("int"), F.coalesce(F.try_element_at(F.split(p, r"\.\."), F.lit(2)).try_cast("int"), F.try_element_at(F.split(p, r"\.\."), F.lit(1)).try_cast("int")))).otherwise(F.array(p.try_cast("int"))))
    return F.transform(F.flatten(parts), lambda n: F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0")))


def seconds(micros: Column) -> Column:
    return micros / F.lit(1_000_000.0)


def sun_elevation(micros: Column, lat: Column, lon: Column) -> Column:
    """Solar elevation in degrees from UTC microseconds: the public low-precision almanac series."""
    ts = F.timestamp_micros(micros.cast("long"))
    day = F.dayofyear(ts)
    leap = (F.year(ts) % 4 == 0) & ((F.year(ts) % 100 != 0) | (F.year(ts) % 400 == 0))
    minutes = F.pmod(micros / F.lit(60_000_000.0), F.lit(1440.0))
    year = F.when(leap, F.lit(366.0)).otherwise(F.lit(365.0))
    g = 2 * math.pi / year * (day - 1 + (minutes / 60 - 12) / 24)
    equation = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    decl = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    hour = F.radians((minutes + equation + 4 * lon) / 4 - 180)
    sine = F.sin(F.radians(lat)) * F.sin(decl) + F.cos(F.radians(lat)) * F.cos(decl) * F.cos(hour)
    return F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), sine))))

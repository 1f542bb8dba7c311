"""Vectors, bounds, spacing, colours and units as Column expressions."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolith.functions import morton as M

AXES = ("x", "y", "z")


def _col(c) -> Column:
    return F.lit(c) if isinstance(c, int | float) else F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Bounds:
    """An axis-aligned box; small enough to live on the driver."""

    low: tuple[float, float, float]
    high: tuple[float, float, float]

    @property
    def extents(self):
        return tuple(b - a for a, b in zip(self.low, self.high, strict=True))

    @property
    def extent(self) -> float:
        return self.high[0] - self.low[0]

    @property
    def centre(self):
        return tuple(a + (b - a) / 2 for a, b in zip(self.low, self.high, strict=True))

    def cubic(self) -> Bounds:
        """The cube around the same centre with the greatest extent."""
        half = max(self.extents) / 2
        return Bounds(tuple(c - half for c in self.centre), tuple(c + half for c in self.centre))

    def at_origin(self) -> Bounds:
        """The cube, moved so that its centre is the origin."""
        return self.cubic().translate(tuple(-c for c in self.cubic().centre))

    def translate(self, by) -> Bounds:
        return Bounds(tuple(a + d for a, d in zip(self.low, by, strict=True)), tuple(b + d for b, d in zip(self.high, by, strict=True)))

    def union(self, other: Bounds) -> Bounds:
        return Bounds(tuple(map(min, self.low, other.low)), tuple(map(max, self.high, other.high)))

    def octant(self, o: int) -> Bounds:
        """Bounds of a child."""
        half = tuple(e / 2 for e in self.extents)
        low = tuple(a + ((o >> (2 - k)) & 1) * h for k, (a, h) in enumerate(zip(self.low, half, strict=True)))
        return Bounds(low, tuple(a + h for a, h in zip(low, half, strict=True)))

    def node(self, name: str) -> Bounds:
        """Bounds of a named node, by descending."""
        return reduce(lambda b, o: b.octant(int(o)), name.removeprefix("r"), self)

    def root_of(self, name: str) -> Bounds:
        """Bounds of the root, if these are the named node's."""
        b = self
        for o in map(int, reversed(name.removeprefix("r"))):
            low = tuple(a - ((o >> (2 - k)) & 1) * e for k, (a, e) in enumerate(zip(b.low, b.extents, strict=True)))
            b = Bounds(low, tuple(a + 2 * e for a, e in zip(low, b.extents, strict=True)))
        return b

    @property
    def diagonal(self) -> float:
        return math.sqrt(sum(e * e for e in self.extents))


def bounds_of(points: DataFrame) -> Bounds | None:
    """Tight bounds in one aggregation (G5, Q2); None without points."""
    r = points.agg(*[f(a).alias(n + a) for n, f in (("low", F.min), ("high", F.max)) for a in AXES]).first()
    return None if r["lowx"] is None else Bounds(tuple(r["low" + a] for a in AXES), tuple(r["high" + a] for a in AXES))


# Vectors


def length(x, y, z) -> Column:
    return F.sqrt(squared_length(x, y, z))


def squared_length(x, y, z) -> Column:
    x, y, z = map(_col, (x, y, z))
    return x * x + y * y + z * z


def squared_distance(a, b) -> Column:
    return squared_length(*(_col(p) - _col(q) for p, q in zip(a, b, strict=True)))


def distance(a, b) -> Column:
    return F.sqrt(squared_distance(a, b))


def manhattan(a, b) -> Column:
    return reduce(lambda s, t: s + t, (F.abs(_col(p) - _col(q)) for p, q in zip(a, b, strict=True)))


# Points and boxes


def inside(bounds: Bounds, x="x", y="y", z="z") -> Column:
    """Closed on both sides."""
    return reduce(lambda s, t: s & t, (_col(p).between(F.lit(a), F.lit(b)) for p, a, b in zip((x, y, z), bounds.low, bounds.high, strict=True)))


def clamp(bounds: Bounds, x="x", y="y", z="z") -> tuple[Column, ...]:
    """Positions outside move to the border."""
    return tuple(F.greatest(F.lit(a), F.least(F.lit(b), _col(p))) for p, a, b in zip((x, y, z), bounds.low, bounds.high, strict=True))


def abort_outside(df: DataFrame, bounds: Bounds) -> DataFrame:
    """The other policy for outliers: fail when the rows are read."""
    ok = inside(bounds)
    return df.withColumn("x", F.when(ok, F.col("x")).otherwise(F.raise_error(F.lit("a point lies outside the bounds")).cast("double")))


def morton_range(bounds: Bounds, name: str) -> tuple[int, int]:
    """Least and greatest key of a node: a filter that Parquet statistics can prune by, beside the exact test."""
    digits = name.removeprefix("r")
    low = int(digits or "0", 8) << 3 * (M.LEVELS - len(digits))
    return low, low + (1 << 3 * (M.LEVELS - len(digits))) - 1


def node_low(idx, lvl, bounds: Bounds) -> tuple[Column, ...]:
    """Lower corner of a node by its grid cell, in closed form."""
    size = F.lit(bounds.extent) / F.pow(F.lit(2.0), _col(lvl))
    return tuple(F.lit(a) + g * size for a, g in zip(bounds.low, M.to_grid(idx), strict=True))


def node_extent(lvl, bounds: Bounds) -> Column:
    return F.lit(bounds.extent) / F.pow(F.lit(2.0), _col(lvl))


def root_low(idx, lvl, low, extent) -> tuple[Column, ...]:
    """Lower corner of the root from a node's bounds."""
    return tuple(_col(a) - g * _col(extent) for a, g in zip(low, M.to_grid(idx), strict=True))


def to_centre_f32(bounds: Bounds) -> tuple[Column, ...]:
    """Positions from the cube's centre, in single precision."""
    return tuple((F.col(a) - F.lit(c)).cast("float").cast("double") for a, c in zip(AXES, bounds.centre, strict=True))


def recentre(df: DataFrame, node: list[str]) -> DataFrame:
    """Positions from their node's least corner, and that corner as ox, oy, oz.

    The corners are one row a node, joined back, so that no node's points have to be in one task.
    """
    low = df.groupBy(*node).agg(*[F.min(a).alias("o" + a) for a in AXES])
    out = df.join(low, node)
    return out.withColumns({a: F.col(a) - F.col("o" + a) for a in AXES})


# Spacing


def spacing_from_diagonal(bounds: Bounds, fraction: float = 250.0) -> float:
    """Single precision, as a share of the cube's diagonal."""
    return float(np.float32(bounds.diagonal / fraction))


def check_spacing(bounds: Bounds, spacing: float) -> None:
    if bounds.extent > 0 and math.log2(bounds.extent / spacing) >= M.LEVELS:
        raise ValueError("the spacing is too small for 21 levels")


def spacing_at(spacing: float, level: int) -> float:
    """At node level -1 (the root), 0, 1, ...."""
    return spacing / 2.0 ** (level + 1)


def candidate_level(extent: float, spacing: float) -> int:
    """The last level whose nodes are at least as large as the spacing, by a single-precision logarithm."""
    return max(-1, int(math.floor(np.log2(np.float32(extent / spacing)))) - 1) if extent > 0 else -1


def candidate_level_column(extent, spacing) -> Column:
    ratio = (_col(extent) / _col(spacing)).cast("float").cast("double")
    return F.greatest(F.lit(-1), F.floor(F.log2(ratio).cast("float")).cast("int") - 1)


def required_depth(sampling: str, level: int, bounds: Bounds, spacing: float) -> int:
    """Deepest key level that a sampler reads at a node level."""
    at = spacing_at(spacing, level)
    if sampling == "JITTERED":
        return level + int(math.log2(max(1, previous_power(int(bounds.extent / 2.0 ** (level + 1) / at)))))
    return candidate_level(bounds.extent, at)


def previous_power(v: int) -> int:
    return 1 << (v.bit_length() - 1) if v > 0 else 0


def geometric_error(spacing, lvl) -> Column:
    """Of a tile at a depth from 0."""
    return _col(spacing) / F.pow(F.lit(2.0), _col(lvl))


# Bounding volumes


def box_volume(low, high, full_extent: bool = False) -> Column:
    """Centre and three half axes; full_extent gives the doubled axes that some writers emit."""
    c = [(_col(a) + _col(b)) / 2 for a, b in zip(low, high, strict=True)]
    h = [(_col(b) - _col(a)) / (1 if full_extent else 2) for a, b in zip(low, high, strict=True)]
    zero = F.lit(0.0)
    return F.array(*c, h[0], zero, zero, zero, h[1], zero, zero, zero, h[2])


# Colours


def rgb_to_8(c) -> Column:
    return F.shiftright(_col(c), 8)


def rgb_to_16(c) -> Column:
    return F.shiftleft(_col(c), 8)


def grey_linear(intensity) -> Column:
    """G14"""
    return F.shiftright(_col(intensity), 8)


def grey_log(intensity) -> Column:
    """The logarithm is taken in single precision."""
    return F.floor(F.log((_col(intensity) + 1).cast("double")).cast("float").cast("double") * 255.0 / math.log(65535.0)).cast("int")


def las_scale(bounds_diagonal) -> Column:
    """Coarser for larger boxes (K3)."""
    d = _col(bounds_diagonal)
    return F.when(d > 1e6, 0.01).when(d > 1, 0.001).otherwise(0.0001)


def align(value, alignment: int) -> Column:
    """The next multiple."""
    return (F.floor((_col(value) + (alignment - 1)) / alignment) * alignment).cast("bigint")


# Units

#: Prefixes and factors (fixed values).
METRIC = [("y", 1e-24), ("z", 1e-21), ("a", 1e-18), ("f", 1e-15), ("p", 1e-12), ("n", 1e-9), ("u", 1e-6), ("m", 1e-3), ("", 1.0), ("k", 1e3), ("M", 1e6), ("G", 1e9), ("T", 1e12), ("P", 1e15), ("E", 1e18), ("Z", 1e21), ("Y", 1e24)]
BINARY = [("", 1.0), *((p + "i", 1024.0 ** (k + 1)) for k, p in enumerate("KMGTPEZY"))]
SIZES = {"B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30, "TiB": 1 << 40}


def with_prefix(quantity, precision: int, prefixes) -> Column:
    """The last prefix that isn't greater than the quantity, the first if all are; ties round to even."""
    q = _col(quantity).cast("double")

    def text(p, f):
        v = q / F.lit(f)
        steps = v * 10.0**precision
        tie = (steps - F.floor(steps) == 0.5) & (F.floor(steps) % 2 == 0)
        return F.concat(F.format_string(f"%.{precision}f", F.when(tie, F.floor(steps) / 10.0**precision).otherwise(v)), F.lit(p))

    out = F.when(q == 0, F.lit("0"))
    for p, f in reversed(prefixes[1:]):
        out = out.when(q >= F.lit(f), text(p, f))
    return out.otherwise(text(*prefixes[0]))


def parse_size(text) -> Column:
    """Bytes of a size such as 10MiB; null for others."""
    t = _col(text)
    factor = F.create_map(*[F.lit(x) for kv in SIZES.items() for x in kv])[F.regexp_extract(t, "([a-zA-Z]+)$", 1)]
    return F.when(t.rlike("^[0-9]+[a-zA-Z]+$"), F.regexp_extract(t, "^([0-9]+)", 1).try_cast("bigint") * factor)


def parse_threads(text: str, cores: int) -> tuple[int, int] | int:
    """'n': threads shared as needed; 'r i': readers and indexers; none: all cores."""
    if not text:
        return cores
    m = re.fullmatch(r"(\d+)(?:\s+(\d+))?", text.strip())
    if not m or int(m[1]) < 1 or (m[2] and int(m[2]) < 1):
        raise ValueError(f"no thread count: {text!r}")
    return (int(m[1]), int(m[2])) if m[2] else int(m[1])

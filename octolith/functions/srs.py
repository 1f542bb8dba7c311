"""Reference systems in closed form as Column expressions (R1-R6): longitude/latitude, UTM and Web Mercator on WGS84.

Angles are in degrees, heights and geocentric coordinates in metres. For other systems a pandas UDF over pyproj is used
where that library is installed.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolith.functions.geometry import _col

#: WGS84 (fixed values).
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
N3 = FLATTENING / (2 - FLATTENING)
#: UTM: scale on the central meridian, false easting and southern false northing (fixed values).
K0, EASTING, SOUTH = 0.9996, 500_000.0, 10_000_000.0
#: Radius of the rectifying sphere and Krueger's series to the fourth order.
RADIUS = A / (1 + N3) * (1 + N3**2 / 4 + N3**4 / 64)
ALPHA = (N3 / 2 - 2 * N3**2 / 3 + 5 * N3**3 / 16 + 41 * N3**4 / 180, 13 * N3**2 / 48 - 3 * N3**3 / 5 + 557 * N3**4 / 1440, 61 * N3**3 / 240 - 103 * N3**4 / 140, 49561 * N3**4 / 161280)
BETA = (N3 / 2 - 2 * N3**2 / 3 + 37 * N3**3 / 96 - N3**4 / 360, N3**2 / 48 + N3**3 / 15 - 437 * N3**4 / 1440, 17 * N3**3 / 480 - 37 * N3**4 / 840, 4397 * N3**4 / 161280)

Point = tuple[Column, Column, Column]


def parse(crs: str | None) -> tuple[str, int, bool]:
    """(kind, zone, south) of a projection string or EPSG code; none and WGS84 are the identity."""
    text = (crs or "").strip()
    if not text or text.upper() == "WGS84" or "+proj=longlat" in text or text.upper() == "EPSG:4326":
        return ("identity" if not text else "longlat"), 0, False
    if m := re.fullmatch(r"EPSG:32([67])(\d\d)", text.upper()):
        return "utm", int(m[2]), m[1] == "7"
    if "+proj=utm" in text and (m := re.search(r"\+zone=(\d+)", text)):
        return "utm", int(m[1]), "+south" in text
    if text.upper() == "EPSG:3857" or "+proj=merc" in text:
        return "merc", 0, False
    if text.upper() == "EPSG:4978" or "+proj=geocent" in text:
        return "geocentric", 0, False
    return "other", 0, False


def longlat_to_geocentric(lon, lat, h) -> Point:
    lam, phi, h = F.radians(_col(lon)), F.radians(_col(lat)), _col(h)
    n = F.lit(A) / F.sqrt(1 - F.lit(E2) * F.sin(phi) * F.sin(phi))
    return (n + h) * F.cos(phi) * F.cos(lam), (n + h) * F.cos(phi) * F.sin(lam), (n * (1 - E2) + h) * F.sin(phi)


def geocentric_to_longlat(x, y, z) -> Point:
    """Bowring's start and two steps: below a tenth of a millimetre near the Earth's surface."""
    x, y, z = map(_col, (x, y, z))
    p, b = F.sqrt(x * x + y * y), A * (1 - FLATTENING)
    beta = F.atan2(z * A, p * b)
    second = E2 / (1 - E2)
    phi = F.atan2(z + second * b * F.pow(F.sin(beta), 3.0), p - E2 * A * F.pow(F.cos(beta), 3.0))
    for _ in range(2):
        beta = F.atan2(F.sin(phi) * b, F.cos(phi) * A)
        phi = F.atan2(z + second * b * F.pow(F.sin(beta), 3.0), p - E2 * A * F.pow(F.cos(beta), 3.0))
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    h = F.when(F.abs(phi) < 0.8, p / F.cos(phi) - n).otherwise(z / F.sin(phi) - n * (1 - E2))
    return F.degrees(F.atan2(y, x)), F.degrees(phi), h


def utm_to_longlat(e, n, h, zone: int, south: bool = False) -> Point:
    xi = (_col(n) - (SOUTH if south else 0.0)) / (K0 * RADIUS)
    eta = (_col(e) - EASTING) / (K0 * RADIUS)
    xi0 = reduce(lambda s, kb: s - kb[1] * F.sin(2 * kb[0] * xi) * F.cosh(2 * kb[0] * eta), enumerate(BETA, 1), xi)
    eta0 = reduce(lambda s, kb: s - kb[1] * F.cos(2 * kb[0] * xi) * F.sinh(2 * kb[0] * eta), enumerate(BETA, 1), eta)
    lam = F.atan2(F.sinh(eta0), F.cos(xi0))
    # Latitude from the conformal one by fixed-point steps on its tangent's series.
    e1, chi = math.sqrt(E2), F.asin(F.sin(xi0) / F.cosh(eta0))
    phi = chi
    for _ in range(6):
        s = F.sin(phi)
        phi = 2 * F.atan(F.tan(math.pi / 4 + chi / 2) * F.pow((1 + e1 * s) / (1 - e1 * s), F.lit(e1 / 2))) - math.pi / 2
    return F.degrees(lam) + (6.0 * zone - 183.0), F.degrees(phi), _col(h)


def longlat_to_utm(lon, lat, h, zone: int, south: bool = False) -> Point:
    phi, lam, e1 = F.radians(_col(lat)), F.radians(_col(lon) - (6.0 * zone - 183.0)), math.sqrt(E2)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e1 * F.atanh(e1 * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north = reduce(lambda a, ka: a + ka[1] * F.sin(2 * ka[0] * xi) * F.cosh(2 * ka[0] * eta), enumerate(ALPHA, 1), xi)
    east = reduce(lambda a, ka: a + ka[1] * F.cos(2 * ka[0] * xi) * F.sinh(2 * ka[0] * eta), enumerate(ALPHA, 1), eta)
    return EASTING + K0 * RADIUS * east, (SOUTH if south else 0.0) + K0 * RADIUS * north, _col(h)


def merc_to_longlat(x, y, h) -> Point:
    return F.degrees(_col(x) / A), F.degrees(2 * F.atan(F.exp(_col(y) / A)) - math.pi / 2), _col(h)


def longlat_to_merc(lon, lat, h) -> Point:
    return A * F.radians(_col(lon)), A * F.log(F.tan(math.pi / 4 + F.radians(_col(lat)) / 2)), _col(h)


def to_longlat(crs: str | None, x="x", y="y", z="z") -> Point:
    """R3"""
    kind, zone, south = parse(crs)
    if kind in ("identity", "longlat"):
        return _col(x), _col(y), _col(z)
    if kind == "utm":
        return utm_to_longlat(x, y, z, zone, south)
    if kind == "merc":
        return merc_to_longlat(x, y, z)
    if kind == "geocentric":
        return geocentric_to_longlat(x, y, z)
    return _pyproj(crs, "EPSG:4979", x, y, z)


def to_geocentric(crs: str | None, x="x", y="y", z="z") -> Point:
    """R2; without a projection positions stay as they are."""
    kind = parse(crs)[0]
    if kind in ("identity", "geocentric"):
        return _col(x), _col(y), _col(z)
    return longlat_to_geocentric(*to_longlat(crs, x, y, z)) if kind != "other" else _pyproj(crs, "EPSG:4978", x, y, z)


def from_longlat(crs: str | None, lon="x", lat="y", h="z") -> Point:
    """R4"""
    kind, zone, south = parse(crs)
    if kind in ("identity", "longlat"):
        return _col(lon), _col(lat), _col(h)
    if kind == "utm":
        return longlat_to_utm(lon, lat, h, zone, south)
    if kind == "merc":
        return longlat_to_merc(lon, lat, h)
    if kind == "geocentric":
        return longlat_to_geocentric(lon, lat, h)
    return _pyproj("EPSG:4979", crs, lon, lat, h)


def _pyproj(source: str, target: str, x, y, z) -> Point:
    try:
        import pyproj  # noqa: F401
    except ImportError:
        raise ValueError(f"{source} to {target} needs pyproj, which isn't installed") from None
    import pandas as pd

    @F.pandas_udf("struct<x:double,y:double,z:double>")
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        import pyproj

        out = pyproj.Transformer.from_crs(source, target, always_xy=True).transform(a, b, c)
        return pd.DataFrame(dict(zip("xyz", out, strict=True)))

    s = run(_col(x), _col(y), _col(z))
    return s["x"], s["y"], s["z"]


def transform(df: DataFrame, crs: str | None, target: str = "geocentric") -> DataFrame:
    """Positions of points in the target system."""
    out = to_geocentric(crs) if target == "geocentric" else to_longlat(crs)
    return df.withColumns(dict(zip("xyz", out, strict=True)))


def transform_bounds(boxes: DataFrame, crs: str | None, keys: list[str], target: str = "geocentric") -> DataFrame:
    """Boxes (low_x ... high_z) around their eight transformed corners."""
    pick = [F.when(F.col("o").bitwiseAND(F.lit(4 >> k)) > 0, F.col(f"high_{a}")).otherwise(F.col(f"low_{a}")).alias(a) for k, a in enumerate("xyz")]
    corners = transform(boxes.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(7)))).select(*keys, *pick), crs, target)
    return corners.groupBy(*keys).agg(*[f(a).alias(f"{n}_{a}") for n, f in (("low", F.min), ("high", F.max)) for a in "xyz"])


def bounding_region(boxes: DataFrame, crs: str | None, keys: list[str]) -> DataFrame:
    """west, south, east, north in radians and least and greatest height of boxes."""
    b = transform_bounds(boxes, crs, keys, "longlat")
    edges = [F.radians(f"{n}_{a}").alias(e) for e, n, a in (("west", "low", "x"), ("south", "low", "y"), ("east", "high", "x"), ("north", "high", "y"))]
    return b.select(*keys, *edges, F.col("low_z").alias("least_height"), F.col("high_z").alias("greatest_height"))

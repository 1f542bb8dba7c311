import math

import pytest
from pyspark.sql import functions as F

from octolith import schema
from octolith.functions import geometry as G
from octolith.functions import srs


def text(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


@pytest.mark.parametrize(("q", "precision", "want"), [(0.0, 3, "0"), (0.1, 0, "100m"), (1e4, 0, "10k"), (1.01, 3, "1.010"), (976.5625e-6, 3, "976.562u"), (1e-30, 0, "0y")])
def test_metric(spark, q, precision, want):
    assert text(spark, G.with_prefix(F.lit(q), precision, G.METRIC)) == want


def test_binary_and_sizes(spark):
    assert text(spark, G.with_prefix(F.lit(2.0**12), 0, G.BINARY)) == "4Ki"
    assert [text(spark, G.parse_size(F.lit(s))) for s in ("12B", "3KB", "2GiB", "5 MB", "7XB", "")] == [12, 3000, 2 << 30, None, None, None]


def test_bounds():
    b = G.Bounds((0.0, 0.0, 0.0), (4.0, 4.0, 4.0))
    assert [b.octant(o).low for o in range(8)] == [(2.0 * (o >> 2), 2.0 * (o >> 1 & 1), 2.0 * (o & 1)) for o in range(8)]
    assert G.Bounds((0.0,) * 3, (2.0,) * 3).node("r0") == G.Bounds((0.0,) * 3, (1.0,) * 3)
    n = G.Bounds((0.0,) * 3, (8.0,) * 3).node("r145")
    assert n == G.Bounds((3.0, 0.0, 5.0), (4.0, 1.0, 6.0)) and n.root_of("r145") == G.Bounds((0.0,) * 3, (8.0,) * 3)
    assert G.Bounds((0.0, 0.0, 0.0), (2.0, 4.0, 8.0)).cubic() == G.Bounds((-3.0, -2.0, 0.0), (5.0, 6.0, 8.0))
    assert b.at_origin().centre == (0.0, 0.0, 0.0)
    assert G.morton_range(b, "r7") == (7 << 60, 2**63 - 1)


def test_levels():
    assert [G.candidate_level(32.0, s) for s in (64, 32, 16, 1)] == [-1, -1, 0, 4]
    assert G.spacing_at(8.0, -1) == 8.0 and G.spacing_at(8.0, 1) == 2.0
    with pytest.raises(ValueError):
        G.check_spacing(G.Bounds((0.0,) * 3, (1.0,) * 3), 1e-9)
    assert G.parse_threads("", 4) == 4 and G.parse_threads("3", 4) == 3 and G.parse_threads("2 5", 4) == (2, 5)
    with pytest.raises(ValueError):
        G.parse_threads("x", 4)
    assert G.required_depth("JITTERED", -1, G.Bounds((0.0,) * 3, (32.0,) * 3), 2.0) == 3


def test_abort_outside(spark):
    df = spark.createDataFrame([(5.0, 0.0, 0.0)], "x double, y double, z double")
    with pytest.raises(Exception, match="outside"):
        G.abort_outside(df, G.Bounds((0.0,) * 3, (1.0,) * 3)).collect()


def test_schema_algebra(spark):
    assert schema.parse_attributes("RGB INTENSITY") == {"RGB", "INTENSITY"}
    with pytest.raises(ValueError):
        schema.parse_attributes("RGB COLOUR")
    assert "RGB" not in schema.las_attributes(1) and "GPS_TIME" in schema.las_attributes(1) and "NORMAL" not in schema.las_attributes(3)
    got = schema.plan_attributes([schema.las_attributes(3), schema.las_attributes(1)], "3DTILES", "INTENSITY_LINEAR")
    assert got[0] == {"POSITION", "INTENSITY"} and got[1] == {"POSITION", "INTENSITY", "RGB"} and "USER_DATA" in got[2]
    flags = schema.IgnoreErrors.parse("missing_files CORRUPTED_FILES")
    assert flags & schema.IgnoreErrors.MISSING_FILES and not flags & schema.IgnoreErrors.UNSUPPORTED_FILE_FORMAT
    with pytest.raises(ValueError):
        schema.IgnoreErrors.parse("NOTHING_SUCH")
    with pytest.raises(ValueError):
        schema.missing_attributes({"a": frozenset({"POSITION"})}, frozenset({"RGB"}))
    assert schema.missing_attributes({"a": frozenset()}, frozenset({"RGB"}), schema.IgnoreErrors.ALL) == {"a": {"RGB"}}
    a = spark.createDataFrame([(1.0, 2.0, 3.0, 7)], "x double, y double, z double, intensity int")
    b = spark.createDataFrame([(1.0, 2.0, 3.0, 5.0)], "x double, y double, z double, gps_time double")
    rows = schema.append(a, b).select("intensity", "gps_time").collect()
    assert sorted(map(tuple, rows)) == [(0, 5.0), (7, 0.0)]


@pytest.mark.parametrize("crs", ["EPSG:32632", "EPSG:32733", "EPSG:3857", "EPSG:4978"])
def test_projections_round_trip(spark, crs):
    south = "327" in crs
    pts = [(9.0 + i, (-1 if south else 1) * (1.0 + 11 * i), 100.0 * i) for i in range(6)]
    df = spark.createDataFrame(pts, "x double, y double, z double")
    there = df.select(*(v.alias(a) for a, v in zip("xyz", srs.from_longlat(crs), strict=True)))
    back = there.select(*(v.alias(a) for a, v in zip("xyz", srs.to_longlat(crs), strict=True))).collect()
    for got, want in zip(sorted(back), sorted(map(tuple, pts)), strict=True):
        assert abs(got.x - want[0]) < 1e-8 and abs(got.y - want[1]) < 1e-8 and abs(got.z - want[2]) < 1e-3


def test_known_positions(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (9.0, 48.0, 0.0)], "x double, y double, z double")
    g = df.select(srs.to_geocentric("EPSG:4326")[0].alias("x")).first()
    assert math.isclose(g.x, 6378137.0)
    e = df.where("x = 9").select(*(v.alias(a) for a, v in zip("xyz", srs.from_longlat("EPSG:32632"), strict=True))).first()
    assert math.isclose(e.x, 500_000.0, abs_tol=1e-6) and math.isclose(e.y, 5_316_300, abs_tol=2000)
    assert srs.parse(None)[0] == "identity" and srs.parse("+proj=utm +zone=32 +south")[1:] == (32, True)
    with pytest.raises(ValueError):
        srs.to_longlat("EPSG:2056")

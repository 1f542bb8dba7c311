"""Samplers, tilers and the incremental tiler: golden cases and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from octolith.functions import geometry as G
from octolith.functions import morton as M
from octolith.operators import samplers as S
from octolith.operators import tiling
from octolith.operators.points import spacing_violations
from octolith.streaming.incremental import IncrementalTiler

CUBE = G.Bounds((0.0,) * 3, (32.0,) * 3)


@pytest.fixture(scope="module")
def lattice(spark):
    i = spark.range(32**3)
    cell = lambda k: ((F.col("id") / 32**k).cast("bigint") % 32 + 0.5).cast("double")
    return i.select("id", cell(2).alias("x"), cell(1).alias("y"), cell(0).alias("z")).cache()


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, p)) for i, p in enumerate(rng.random((4000, 3)) * 30 + 1)]
    return spark.createDataFrame(rows, "id bigint, x double, y double, z double").cache()


def ctx(spacing, capacity=16, bounds=CUBE):
    return S.Context(bounds, spacing, capacity, ("id",))


def test_lattice_golden(lattice):
    """Spacing 32 at the root gives cells of half the edge: eight points, the first of each in key order."""
    c = ctx(16.0)
    got = S.sampler("RANDOM_GRID").mark(S.with_keys(lattice, CUBE), -1, c).where("selected").orderBy("morton").collect()
    assert [(r.x, r.y, r.z) for r in got] == [(x, y, z) for x in (0.5, 16.5) for y in (0.5, 16.5) for z in (0.5, 16.5)]
    assert S.sampler("RANDOM_GRID").mark(S.with_keys(lattice, CUBE), -1, ctx(32.0)).where("selected").count() == 1


def test_centre_and_jitter_pick_the_closest(cloud):
    keyed = S.with_keys(cloud, CUBE)
    rows = [(r.id, r.x, r.y, r.z) for r in keyed.collect()]
    got = {r.id for r in S.sampler("GRID_CENTER").mark(keyed, -1, ctx(8.0)).where("selected").collect()}
    best = {}
    for i, *p in rows:
        cell = tuple(int(v // 8) for v in p)
        d = sum((v - (k + 0.5) * 8) ** 2 for v, k in zip(p, cell, strict=True))
        best[cell] = min(best.get(cell, (9e9, 0)), (d, i))
    assert got == {i for _, i in best.values()}
    perm = S.affine_permutations(16)
    assert all(sorted(p) == list(range(1, 17)) for p in perm)
    got = {r.id for r in S.sampler("JITTERED").mark(keyed, -1, ctx(2.0)).where("selected").collect()}
    best = {}
    for i, *p in rows:
        g = [int(v // 2) for v in p]
        jitter = [perm[0][(g[1] + g[2]) % 16] - 1, perm[1][(g[0] + g[2]) % 16] - 1, perm[2][(g[0] + g[1]) % 16] - 1]
        d = sum((v - (k * 2 + j * 0.125)) ** 2 for v, k, j in zip(p, g, jitter, strict=True))
        best[tuple(g)] = min(best.get(tuple(g), (9e9, 0)), (d, i))
    assert got == {i for _, i in best.values()}
    with pytest.raises(ValueError, match="16 cells"):
        S.sampler("JITTERED").mark(keyed, -1, ctx(4.0))
    with pytest.raises(ValueError, match="unknown sampling"):
        S.sampler("NONE")


def test_greedy_samplers(cloud):
    keyed = S.with_keys(cloud, CUBE)
    order = [r for r in keyed.orderBy("morton", "id").collect()]
    near = lambda a, b, s: sum((getattr(a, c) - getattr(b, c)) ** 2 for c in "xyz") < s * s
    kept = []
    for p in order:
        if not any(near(p, q, 4.0) for q in kept):
            kept.append(p)
    marked = S.sampler("MIN_DISTANCE").mark(keyed, -1, ctx(4.0))
    assert {r.id for r in marked.where("selected").collect()} == {p.id for p in kept} and marked.count() == 4000
    assert tuple(spacing_violations(marked, 4.0, ["id"]).first()) == (0, 0)
    last, want = None, set()
    for p in order:
        if last is None or not near(p, last, 4.0):
            want.add(p.id)
            last = p
    assert {r.id for r in S.sampler("Z_ORDER_NEXT").mark(keyed, -1, ctx(4.0)).where("selected").collect()} == want
    kept = []
    for p in order[::4]:
        if not any(near(p, q, 4.0) for q in kept):
            kept.append(p)
    assert {r.id for r in S.sampler("MIN_DISTANCE_FAST").mark(keyed, -1, ctx(4.0)).where("selected").collect()} == {p.id for p in kept}


@pytest.mark.parametrize("sampling", ["RANDOM_GRID", "GRID_CENTER", "MIN_DISTANCE", "JITTERED"])
def test_accurate_invariants(cloud, sampling):
    out, c = tiling.tile(cloud, ["id"], sampling, "ACCURATE", diagonal_fraction=30, max_points_per_node=20)
    rows = out.collect()
    assert sorted(r.id for r in rows) == list(range(4000))
    by_node = {}
    for r in rows:
        assert r.morton >> (63 - 3 * r.node_lvl) == r.node_idx and r.node_name == "r" + (f"{r.node_idx:o}".zfill(r.node_lvl) if r.node_lvl else "")
        box = c.bounds.node(r.node_name)
        assert all(a - 1e-9 <= v <= b + 1e-9 for v, a, b in zip((r.x, r.y, r.z), box.low, box.high, strict=True))
        by_node.setdefault(r.node_name, []).append(r)
    interior = {n[:-1] for n in by_node if n != "r"}
    if sampling == "MIN_DISTANCE":
        for name in interior & by_node.keys():
            own, s = by_node[name], c.spacing / 2 ** (len(name) - 1)
            if len(own) > 20:
                a = np.array([(r.x, r.y, r.z) for r in own])
                d = ((a[:, None] - a[None]) ** 2).sum(axis=2) + np.eye(len(a)) * 1e9
                assert d.min() >= (s * (1 - 1e-6)) ** 2


def test_fast_rebuilds_levels(cloud):
    out, c = tiling.tile(cloud, ["id"], "RANDOM_GRID", "FAST", diagonal_fraction=30, max_points_per_node=20, start=3)
    low = out.where("node_lvl >= 3")
    assert low.count() == 4000 and low.select("id").distinct().count() == 4000
    names = {r.node_name for r in out.select("node_name").distinct().collect()}
    assert all(n[:k] in names for n in names for k in range(1, len(n))) and out.count() > 4000
    assert tiling.start_level(S.with_keys(cloud, c.bounds), 8) == 6 and tiling.start_level(S.with_keys(cloud, c.bounds), 8, 100) == 3
    assert tiling.tile(cloud, ["id"], "MIN_DISTANCE", "FAST", diagonal_fraction=30, max_points_per_node=20, workers=2)[0].where("node_lvl >= 6").count() == 4000
    with pytest.raises(ValueError):
        tiling.tile(cloud, ["id"], strategy="SLOW")


def test_degenerate_inputs(spark):
    schema = "id bigint, x double, y double, z double"
    assert tiling.tile(spark.createDataFrame([], schema), ["id"])[0].count() == 0
    same = spark.createDataFrame([(i, 1.0, 2.0, 3.0) for i in range(50)], schema)
    assert tiling.tile(same, ["id"], "RANDOM_GRID", "ACCURATE", spacing=1.0, max_points_per_node=10)[0].count() == 50
    one = spark.createDataFrame([(0, 5.0, 5.0, 5.0)], schema)
    assert [r.node_name for r in tiling.tile(one, ["id"], "RANDOM_GRID", "ACCURATE", spacing=1.0)[0].collect()] == ["r"]


def test_deep_trees_lose_nothing(cloud):
    wide = G.Bounds((0.0,) * 3, (2.0**24,) * 3)
    out = tiling.tile_deep(cloud, ["id"], 40, sampling="RANDOM_GRID", bounds=wide, spacing=2.0**22, max_points_per_node=500)
    assert out.count() == 4000 and out.select("id").distinct().count() == 4000
    assert out.agg(F.max(F.length("node_name"))).first()[0] > 20


def test_balanced_start_nodes(cloud):
    parts = tiling.balanced_start_nodes(S.with_keys(cloud, CUBE), 20)
    assert sum(n for *_, n in parts) == 4000 and len(parts) >= 20
    spans = sorted((i << 3 * (6 - lvl), (i + 1) << 3 * (6 - lvl)) for i, lvl, _ in parts)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("start", [0, 3])
def test_incremental(spark, cloud, start):
    c = S.Context(CUBE, G.spacing_from_diagonal(CUBE, 30), 20, ("id",))
    tiler = IncrementalTiler(spark, c, "RANDOM_GRID", start=start)
    for k in range(3):
        tiler.process(cloud.where(f"id % 3 = {k}"), k)
        tiler.process(cloud.where(f"id % 3 = {k}"), k)  # a repeated batch changes nothing
    rows = tiler.stored().collect()
    assert sorted(r.id for r in rows) == list(range(4000)) and min(r.node_lvl for r in rows) == start
    for r in rows:
        assert r.morton >> (63 - 3 * r.node_lvl) == r.node_idx
    full = tiler.finish()
    assert full.where("node_lvl = 0").count() > 0 and full.count() >= 4000


def test_plans_prune_and_stay_native(spark):
    from octolith.plans import views

    pts, cube = views.keyed(spark, "/root/testdata/sf0.001")
    plan = S.sampler("RANDOM_GRID").mark(pts.select("morton", F.col("ok").alias("id")), -1, ctx(4.0)).select("id", "selected")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "l_tax" not in text and text.count("Exchange") == 1
    assert math.isclose(cube.extent, max(cube.extents))
    assert M.LEVELS == 21


def test_scan_equals_sparse_grid():
    rng = np.random.default_rng(6)
    for n, spacing, step in ((0, 1.0, 1), (500, 0.1, 1), (500, 0.3, 2), (200, 5.0, 1)):
        xyz = rng.normal(0, 1, (n, 3))
        grid = S.SparseGrid(spacing)
        assert S.poisson(xyz, spacing, step).tolist() == [i % step == 0 and grid.add(tuple(p)) for i, p in enumerate(xyz.tolist())]

"""Subtrees in one pass give what levels one by one give, without a level's points going through one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from octolith.functions import geometry as G
from octolith.operators import descent, tiling
from octolith.operators import samplers as S
from octolith.session import materialize

CUBE = G.Bounds((0.0,) * 3, (32.0,) * 3)


@pytest.fixture(scope="module")
def crowd(spark):
    """A cloud, a crowd at one spot, and rows on one place that the tie alone tells apart."""
    rng = np.random.default_rng(9)
    xyz = np.concatenate([rng.random((3000, 3)) * 30 + 1, rng.random((1500, 3)) * 0.01 + 7, np.full((500, 3), 20.0)])
    return materialize(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id bigint, x double, y double, z double").repartition(4), "crowd")


def by_levels(points, ctx, how, first):
    """The definition: mark_level() on all that is left, level by level."""
    out, rest = {}, points
    for level in range(first, 21):
        marked = materialize(tiling.mark_level(rest, level, ctx, how, last=level == 20), "level")
        out |= {r.id: level + 1 for r in marked.where("selected").select("id").collect()}
        rest = marked.where("NOT selected").drop("selected")
        if rest.isEmpty():
            return out


@pytest.mark.parametrize("sampling,first,held", [("RANDOM_GRID", -1, 400), ("RANDOM_GRID", 2, 1_000_000), ("GRID_CENTER", -1, 400), ("JITTERED", -1, 1_000_000)])
def test_one_pass_equals_levels(spark, crowd, monkeypatch, sampling, first, held):
    monkeypatch.setattr(descent, "HELD", held)
    ctx, how = S.Context(CUBE, G.spacing_from_diagonal(CUBE, 30), 20, ("id",)), S.sampler(sampling)
    keyed = S.with_keys(crowd, CUBE)
    got = tiling.descend(keyed, ctx, how, first).select("id", "node_idx", "node_lvl", "morton").collect()
    assert len(got) == 5000 and all(r.morton >> (63 - 3 * r.node_lvl) == r.node_idx for r in got)
    assert {r.id: r.node_lvl for r in got} == by_levels(keyed, ctx, how, first)


def test_deep_trees_go_down_together(spark, crowd, monkeypatch):
    """Levels that see all points in one cell aren't written one by one: a handful of tables instead of one a level."""
    written = []
    monkeypatch.setattr(tiling, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    monkeypatch.setattr(descent, "HELD", 400)
    out = tiling.tile_deep(crowd, ["id"], 40, sampling="RANDOM_GRID", bounds=G.Bounds((0.0,) * 3, (2.0**24,) * 3), spacing=2.0**22, max_points_per_node=100)
    assert out.agg(F.count(F.lit(1)), F.countDistinct("id")).first()[:] == (5000, 5000)
    assert len(written) < 16


def test_accurate_trees_are_dealt_once(spark, crowd, monkeypatch):
    """One table of a dataset's points, not one a level."""
    written = []
    monkeypatch.setattr(tiling, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    for sampling in ("RANDOM_GRID", "GRID_CENTER", "JITTERED"):
        out, _ = tiling.tile(crowd, ["id"], sampling, "ACCURATE", diagonal_fraction=30, max_points_per_node=20)
        assert out.count() == 5000 and out.agg(F.max("node_lvl")).first()[0] > 3
    assert len(written) == 3

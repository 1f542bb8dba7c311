"""Incremental tiling by subtrees gives what it gives level by level, and deals a point once a batch."""

import numpy as np
import pytest

from octolith.functions import geometry as G
from octolith.operators import descent
from octolith.operators import samplers as S
from octolith.session import materialize
from octolith.streaming import incremental

CUBE = G.Bounds((0.0,) * 3, (32.0,) * 3)


@pytest.mark.parametrize("sampling,start", [("RANDOM_GRID", 0), ("GRID_CENTER", 2)])
def test_subtrees_equal_levels(spark, monkeypatch, sampling, start):
    rng = np.random.default_rng(11)
    xyz = rng.random((3000, 3)) ** 2 * 31
    points = materialize(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id bigint, x double, y double, z double"), "points")
    ctx, got = S.Context(CUBE, 3.0, 40, ("id",)), []
    monkeypatch.setattr(descent, "SUBTREE", 300)
    for subtrees in (True, False):
        written = []
        monkeypatch.setattr(incremental, "materialize", lambda df, name, w=written: w.append(name) or materialize(df, name))
        tiler = incremental.IncrementalTiler(spark, ctx, sampling, start=start, max_level=8)
        if not subtrees:
            monkeypatch.setattr(tiler, "by_subtrees", lambda rest, k: False)
        for k, part in enumerate(("id < 900", "id BETWEEN 900 AND 1999", "id >= 2000 AND x > 5")):
            tiler.process(points.where(part), k)
        got.append(sorted(tiler.stored().select("id", "node_idx", "node_lvl").collect()))
        assert not subtrees or written == ["batch"] * 3
    assert got[0] == got[1] and len({r.id for r in got[0]}) == len(got[0])

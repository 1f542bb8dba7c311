"""State that outlives its process, and scans that take a node piece by piece."""

import numpy as np
import pytest

from octolith.functions import geometry as G
from octolith.operators import samplers
from octolith.session import work_path
from octolith.streaming.incremental import IncrementalTiler


@pytest.mark.parametrize("step", [1, 4])
@pytest.mark.parametrize("scan", [samplers.PoissonScan, samplers.NextScan])
def test_pieces_give_the_picks_of_the_whole(scan, step):
    xyz = np.random.default_rng(3).uniform(-1e6, 1e6, (3000, 3))
    whole, pieces = scan(2e5, step).take(xyz), scan(2e5, step)
    assert np.concatenate([pieces.take(xyz[a : a + 77]) for a in range(0, 3000, 77)]).tolist() == whole.tolist() and whole.any()


def test_scan_equals_the_grid():
    xyz = np.random.default_rng(5).uniform(-3, 3, (800, 3))
    grid = samplers.SparseGrid(0.5)
    assert samplers.poisson(xyz, 0.5).tolist() == [grid.add(tuple(p)) for p in xyz]


def test_a_new_tiler_goes_on(spark):
    pts = spark.range(6000).selectExpr("id", "pmod(id * 7919, 1000) / 10D AS x", "pmod(id * 104729, 1000) / 10D AS y", "pmod(id * 31, 1000) / 10D AS z")
    ctx, path = samplers.Context(G.Bounds((0.0,) * 3, (100.0,) * 3), 20.0, 300, ("id",)), work_path(spark, "durable")
    whole = IncrementalTiler(spark, ctx)
    for k in (0, 1):
        part = pts.where(f"id % 2 = {k}")
        whole.process(part, k)
        IncrementalTiler(spark, ctx, path=path).process(part, k)  # a process of its own, so to speak
    last = IncrementalTiler(spark, ctx, path=path)
    last.process(pts.where("id % 2 = 1"), 1)  # delivered twice
    rows = lambda t: sorted(t.stored().select("id", "node_idx", "node_lvl").collect())
    assert rows(last) == rows(whole) and len(rows(last)) == 6000
    with pytest.raises(ValueError, match="other parameters"):
        IncrementalTiler(spark, ctx, "GRID_CENTER", path=path)

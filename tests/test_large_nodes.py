"""Files of nodes larger than a task holds are the same, byte by byte, and are read back in pieces."""

import pytest
from pyspark.sql import functions as F

from octolith.functions import geometry as G
from octolith.session import materialize, work_path
from octolith.sources import codecs, files, nodes

LOW, HIGH = (0.0,) * 3, (100.0,) * 3


@pytest.fixture(scope="module")
def tiled(spark):
    pts = spark.range(5000).selectExpr("id AS morton", "pmod(id * 7919, 1000) / 10D AS x", "pmod(id * 104729, 1000) / 10D AS y", "pmod(id * 31, 1000) / 10D AS z")
    pts = pts.withColumns({"intensity": F.pmod("morton", F.lit(60000)).cast("int"), **{c: F.pmod("morton", F.lit(200 + k)).cast("smallint") for k, c in enumerate("rgb")}})
    big = pts.withColumns({"node_idx": F.when(F.col("morton") < 300, 1).otherwise(2).cast("bigint"), "node_lvl": F.lit(1)})
    return materialize(big.withColumn("node_name", F.concat(F.lit("r"), "node_idx")), "tiled")


@pytest.mark.parametrize("fmt", ["BIN", "BINZ", "LAS", "3DTILES", "ENTWINE_LAS"])
def test_pieces_make_the_same_file(spark, tiled, monkeypatch, fmt):
    box, out = G.Bounds(LOW, HIGH), work_path(spark, "large")
    monkeypatch.setattr(nodes, "HELD", 700)
    got = {r.node_name: r.n for r in nodes.write_nodes(tiled, out, fmt, box).collect()}
    assert got == {"r1": 300, "r2": 4700}
    rows = tiled.where("node_idx = 2").orderBy("morton").toArrow()
    want = {c: rows.column(c).to_numpy() for c in ("x", "y", "z", "intensity", "r", "g", "b")}
    data = files.read_whole(nodes.path_of(out, fmt, "r2"))
    if fmt == "BINZ":
        assert (codecs.decode_bin(data, True)["x"] == want["x"]).all()
    else:
        assert data == nodes.encode_node(want, fmt, box, "r2")
    back = nodes.read_nodes(spark, out, fmt, {"INTENSITY"})
    assert back.count() == 5000 and back.agg(F.sum("intensity")).first()[0] == int(rows.column("intensity").to_numpy().sum()) + 299 * 150

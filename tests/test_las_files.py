"""LAS files of the queries, and partitions of many splits."""

from pyspark.sql import functions as F

from octolith.plans import formats
from octolith.sources import codecs, las
from octolith.sources.files import expand, read_whole
from tests.conftest import SF


def test_no_task_holds_more_than_a_files_points(spark, monkeypatch):
    monkeypatch.setattr(formats, "LAS_FILE", 500)
    folder, keys = formats._las_files(spark, SF)
    counts = [codecs.las_header(read_whole(f))["n_points"] for f in expand([folder])]
    assert len(counts) == len(keys) >= 12 and sum(counts) == 6000 and max(counts) < 700 and set(keys) == {0, 1, 2, 3}
    want = spark.read.parquet(f"{SF}/lineitem.parquet").groupBy((F.col("l_partkey") % 4).cast("int").alias("k")).count()
    want = {r["k"]: r["count"] for r in want.collect()}
    assert {r.file_id: r.n_points for r in formats.s5(spark, SF).collect()} == want
    assert {r.file_id: r.n for r in formats.s6(spark, SF).collect()} == want


def test_partitions_take_several_splits(spark, monkeypatch):
    monkeypatch.setattr(las, "PARTITIONS", 5)
    folder, _ = formats._las_files(spark, SF)
    reader = las.LasReader({"path": folder, "splitPoints": "100"}, [("intensity", "int"), ("file_id", "int")])
    parts = reader.partitions()
    assert len(parts) <= 5 and sum(s.count for p in parts for s in p.slices) == 6000 and max(s.count for p in parts for s in p.slices) == 100
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 6000

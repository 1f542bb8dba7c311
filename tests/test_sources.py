import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from octolith import convert, schema
from octolith.functions import geometry as G
from octolith.operators import tiling
from octolith.schema import IgnoreErrors
from octolith.session import work_path
from octolith.sources import codecs, files, las, nodes

LOW, HIGH = (0.0,) * 3, (1.0,) * 3


def full(n=1024, seed=0):
    rng = np.random.default_rng(seed)
    out = dict(zip("xyz", rng.random((3, n)), strict=True))
    limits = {"intensity": 65536, "classification": 32, "edge_of_flight_line": 2, "number_of_returns": 6, "return_number": 6, "point_source_id": 256, "scan_direction_flag": 2, "user_data": 256, "r": 256, "g": 256, "b": 256}
    return out | {c: rng.integers(0, k, n) for c, k in limits.items()} | {"gps_time": rng.random(n), "scan_angle_rank": rng.integers(-90, 91, n)}


@pytest.mark.parametrize("compress", [False, True])
def test_bin_is_exact(compress):
    p = full() | {c: np.random.default_rng(1).random(1024).astype(np.float32) for c in ("nx", "ny", "nz")}
    back = codecs.decode_bin(codecs.encode_bin(p, compress), compress)
    assert back.keys() == p.keys() and all((back[c] == p[c]).all() for c in p)
    data = codecs.encode_bin({c: p[c] for c in "xyz"})
    assert struct.unpack_from("<IQ", data) == (0, 1024) and len(data) == 12 + 24 * 1024
    with pytest.raises(ValueError):
        codecs.encode_bin({c: np.zeros(0) for c in "xyz"})


def test_las_fields_and_error():
    p = full()
    data = codecs.encode_las(p, LOW, HIGH, 0.001)
    h = codecs.las_header(data)
    assert (h["version"], h["point_format"], h["record_length"], h["n_points"], h["low"], h["high"], h["point_offset"]) == ((1, 2), 3, 34, 1024, LOW, HIGH, 227)
    back = codecs.decode_las(data[227:], h)
    assert 0 < max(np.abs(back[c] - p[c]).max() for c in "xyz") < 0.001
    same = set(p) - set("xyz") - {"number_of_returns", "return_number"}
    assert all((back[c] == p[c]).all() for c in same) and (back["return_number"] == p["return_number"]).all()
    assert codecs.decode_las(data[227:], h, {"INTENSITY"}).keys() == {"x", "y", "z", "intensity"}
    assert [codecs.las_scale((0,) * 3, (v,) * 3) for v in (0.1, 10, 1e6)] == [0.0001, 0.001, 0.01]
    for fmt in range(4):
        assert codecs.record_type(fmt, (20, 28, 26, 34)[fmt]).itemsize == (20, 28, 26, 34)[fmt]
    assert codecs.record_type(1, 30).itemsize == 30
    with pytest.raises(ValueError, match="LAZ"):
        codecs.las_header(data[:104] + bytes([0x83]) + data[105:])
    with pytest.raises(ValueError, match="not a LAS"):
        codecs.las_header(b"nothing" * 40)


def test_pnts_layout():
    p = {c: v[:100] for c, v in full().items()}
    data = codecs.encode_pnts(p, (1.0, 2.0, 3.0))
    magic, version, size, table, body, *_ = struct.unpack_from("<4s6I", data)
    assert (magic, version, size) == (b"pnts", 1, len(data)) and (28 + table) % 8 == 0 and body % 8 == 0
    spec = json.loads(data[28 : 28 + table])
    assert spec["POINTS_LENGTH"] == 100 and spec["RTC_CENTER"] == [1, 2, 3] and spec["INTENSITY"]["byteOffset"] % 2 == 0
    back, centre = codecs.decode_pnts(data)
    assert centre == (1, 2, 3) and (back["x"] == p["x"].astype(np.float32)).all() and (back["b"] == p["b"]).all()


def test_key_file():
    keys, levels = codecs.decode_keys(codecs.encode_keys(np.arange(32) * 7, 10))
    assert keys.tolist() == [7 * i for i in range(32)] and levels == 10
    with pytest.raises(ValueError):
        codecs.decode_keys(b"abcd" + b"\0" * 12)


def local(spark, name):
    return work_path(spark, name)


def test_las_source(spark):
    folder, p = local(spark, "las"), full(2500)
    files.write_whole(f"{folder}/b/two.LAS", codecs.encode_las(full(10, 2), LOW, HIGH))
    files.write_whole(f"{folder}/one.las", codecs.encode_las(p, LOW, HIGH))
    files.write_whole(f"{folder}/readme.txt", b"x")
    spark.dataSource.register(las.LasSource)
    with pytest.raises(ValueError, match="isn't supported"):
        las.input_files([folder])
    with pytest.raises(FileNotFoundError):
        las.input_files([f"{folder}/none.las"])
    skip = "UNSUPPORTED_FILE_FORMAT MISSING_FILES"
    assert len(las.input_files([folder, f"{folder}/none"], IgnoreErrors.parse(skip))) == 2
    read = lambda **o: spark.read.format("las").options(path=folder, ignore=skip, **o).load()
    df = read(splitPoints="1000")
    assert df.count() == 2510 and df.rdd.getNumPartitions() == 4
    assert read(columns="intensity,file_id").where("file_id = 1").agg(F.sum("intensity")).first()[0] == int(p["intensity"].sum())
    assert sorted(r.n_points for r in read(header="true").collect()) == [10, 2500]
    files.write_whole(f"{folder}/cut.las", codecs.encode_las(p, LOW, HIGH)[:5000])
    with pytest.raises(Exception, match="ends before"):
        read().count()
    got = spark.read.format("las").options(path=folder, ignore=skip + " CORRUPTED_FILES").load()
    assert 2510 < got.count() < 5010


@pytest.mark.parametrize("fmt", ["BIN", "BINZ", "LAS", "3DTILES", "ENTWINE_LAS"])
def test_tile_files_and_convert(spark, fmt):
    folder, out, again = local(spark, "in"), local(spark, "out"), local(spark, "again")
    p = full(3000, 5)
    for c in "xyz":
        p[c] = p[c] * 100
    files.write_whole(f"{folder}/a.las", codecs.encode_las(p, LOW, (100.0,) * 3))
    written = convert.tile_files(spark, [folder], out, fmt, "RANDOM_GRID", "ACCURATE", diagonal_fraction=30, max_points_per_node=100, rgb_from="INTENSITY_LINEAR")
    assert written.agg(F.sum("n")).first()[0] == 3000
    back = nodes.read_nodes(spark, out, fmt, {"INTENSITY"})
    assert back.agg(F.sum("intensity")).first()[0] == p["intensity"].sum()
    d = nodes.read_descriptor(out)
    assert d["naming"] == "potree" and d["spacing"] > 0
    if fmt == "3DTILES":
        tiles = json.loads(files.read_whole(f"{out}/tileset.json"))
        assert tiles["root"]["content"]["uri"] == "r.pnts" and tiles["asset"]["version"] == "0.0"
    if fmt == "ENTWINE_LAS":
        ept = json.loads(files.read_whole(f"{out}/ept.json"))
        root = json.loads(files.read_whole(f"{out}/ept-hierarchy/0-0-0-0.json"))
        assert ept["points"] == 3000 and root["0-0-0-0"] > 0 and {x["name"] for x in ept["schema"]} >= {"X", "Red", "GpsTime"}
    target = "LAS" if fmt == "3DTILES" else "3DTILES"
    convert.convert(spark, out, again, target, max_depth=1)
    want = back.where("node_lvl <= 1").count()
    assert nodes.read_nodes(spark, again, target, {"INTENSITY"}).count() == want
    convert.convert(spark, out, again, target, delete_source=True)
    assert not files.exists(nodes.path_of(out, fmt, "r"))


def test_formats_and_directories(spark):
    for fmt in ("LAZ", "ENTWINE_LAZ", "XYZ"):
        with pytest.raises(ValueError):
            nodes.check_format(fmt)
    assert nodes.entwine_name("r") == "0-0-0-0" and nodes.entwine_name("r4210") == "4-8-4-2"
    out = local(spark, "dir")
    files.write_whole(f"{out}/journal/log", b"1")
    files.write_whole(f"{out}/old/x", b"1")
    files.clear_directory(out)
    assert files.exists(f"{out}/journal/log") and not files.exists(f"{out}/old/x")
    with pytest.raises(FileNotFoundError):
        nodes.read_descriptor(out)
    files.write_whole(f"{out}/cloud.js", json.dumps({"boundingBox": {"lx": 0, "ly": 0, "lz": 0, "ux": 1, "uy": 1, "uz": 1}, "spacing": 0.5}).encode())
    assert nodes.read_descriptor(out)["spacing"] == 0.5
    assert schema.FORMATS["BIN"] == schema.ALL


def test_tilesets_fill_gaps(spark):
    own = spark.createDataFrame([(0o1234, 4, 5), (0, 0, 3)], "node_idx bigint, node_lvl int, n bigint")
    out = local(spark, "gaps")
    nodes.write_tilesets(own, out, G.Bounds(LOW, HIGH), 8.0).count()
    root = json.loads(files.read_whole(f"{out}/tileset.json"))["root"]
    third = root["children"][0]["children"][0]["children"][0]
    assert root["content"]["uri"] == "r.pnts" and third["content"]["uri"] == "r123.json" and third["geometricError"] == 1.0
    sub = json.loads(files.read_whole(f"{out}/r123.json"))["root"]
    assert "content" not in sub and sub["children"][0]["content"]["uri"] == "r1234.pnts"


def test_memory_store(spark):
    from octolith.sources.memory import MemoryStore

    df = spark.createDataFrame([(1.0, "r"), (2.0, "r1")], "x double, node_name string")
    store = MemoryStore()
    with pytest.raises(ValueError):
        store.nodes()
    store.append(df)
    store.append(df)
    assert store.nodes("r").count() == 2
    store.replace(df.where("node_name = 'r'"))
    assert store.nodes("r").count() == 1 and store.nodes("r1").count() == 2
    assert tiling.dropped(df, store.nodes("r")).first().dropped == 1

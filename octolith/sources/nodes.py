"""Node files of a tiled dataset: writing, reading and what describes them.

A node is written by the task that has its points, whole and under its final name; nothing but counts goes to the driver.
Hierarchies and tilesets are written per subtree by tasks too, so that a dataset may have any number of nodes.
"""

from __future__ import annotations

import json
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith import schema
from octolith.functions import geometry as G
from octolith.functions import morton as M
from octolith.operators import tree
from octolith.sources import codecs
from octolith.sources.files import clear_directory, exists, read_whole, write_pieces, write_whole

#: Extension, and whether positions come back as they were.
EXTENSIONS = {"BIN": (".bin", True), "BINZ": (".binz", True), "LAS": (".las", False), "ENTWINE_LAS": (".las", False), "3DTILES": (".pnts", True)}
WRITTEN = "node_idx bigint, node_lvl int, node_name string, n bigint"


def check_format(fmt: str) -> tuple[str, bool]:
    if fmt in ("LAZ", "ENTWINE_LAZ"):
        raise ValueError("LAZ can't be written: no LASzip here; use LAS")
    if fmt not in EXTENSIONS:
        raise ValueError(f"unknown output format {fmt!r}")
    return EXTENSIONS[fmt]


def entwine_name(name: str) -> str:
    digits = name.removeprefix("r")
    grid = [int("".join(str(int(d) >> s & 1) for d in digits) or "0", 2) for s in (2, 1, 0)]
    return "-".join(map(str, (len(digits), *grid)))


def encode_node(points: codecs.Points, fmt: str, bounds: G.Bounds, name: str, centre=(0.0, 0.0, 0.0)) -> bytes:
    if fmt in ("BIN", "BINZ"):
        return codecs.encode_bin(points, fmt == "BINZ")
    if fmt == "3DTILES":
        return codecs.encode_pnts(points, centre)
    box = bounds.node(name)
    return codecs.encode_las(points, box.low, box.high)


def path_of(out: str, fmt: str, name: str) -> str:
    extension = check_format(fmt)[0]
    return f"{out}/ept-data/{entwine_name(name)}{extension}" if fmt.startswith("ENTWINE") else f"{out}/{name}{extension}"


def to_numpy(table: pa.Table) -> codecs.Points:
    return {c: table.column(c).to_numpy() for c in table.column_names}


#: Points of a node that a task holds; what a larger node has more goes through temporary files.
HELD = 500_000


def name_of(idx: int, lvl: int) -> str:
    return "r" + (f"{idx:o}".zfill(lvl) if lvl else "")


def write_nodes(tiled: DataFrame, out: str, fmt: str, bounds: G.Bounds, rgb_from: str = "NONE") -> DataFrame:
    """Write each node's points to its file; node_idx, node_lvl, node_name, n of what was written.

    tiled: points with node_idx, node_lvl, node_name, and perhaps ox, oy, oz: the position that a node's points count
    from. A node's file holds its points in key order. Tasks get nodes as sorted streams; names and what isn't written
    aren't dealt.
    """
    check_format(fmt)
    if fmt == "3DTILES" and rgb_from != "NONE" and "intensity" in tiled.columns:
        grey = G.grey_linear("intensity") if rgb_from == "INTENSITY_LINEAR" else G.grey_log("intensity")
        tiled = tiled.withColumns({c: grey.cast("smallint") for c in "rgb"})
    keep = [c for c, _ in schema.columns_of(schema.attributes_of(tiled) & schema.FORMATS[fmt])]
    order = "morton" if "morton" in tiled.columns else "x"
    origin = [c for c in ("ox", "oy", "oz") if c in tiled.columns]
    key = ["node_idx", "node_lvl"]

    def finish(now, spool: codecs.Spool | None, tables: list[pa.Table], n: int, centre) -> pa.RecordBatch:
        name, points = name_of(*now), to_numpy(pa.concat_tables(tables).select(keep))
        path = path_of(out, fmt, name)
        if spool is None:
            write_whole(path, encode_node(points, fmt, bounds, name, centre))
        else:
            box = bounds.node(name)
            spool.add(points, box.low, box.high)
            write_pieces(path, spool.file(points, n, box.low, box.high, centre))
            spool.close()
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*now, name, n), (pa.int64(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["node_idx", "node_lvl", "node_name", "n"])

    def write(batches):
        now, spool, tables, held, n, centre = None, None, [], 0, 0, (0.0, 0.0, 0.0)
        for batch in batches:
            idx, lvl = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in key)
            edges = [0, *(np.flatnonzero((idx[1:] != idx[:-1]) | (lvl[1:] != lvl[:-1])) + 1).tolist(), len(idx)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                at = (int(idx[a]), int(lvl[a]))
                if at != now:
                    if now is not None:
                        yield finish(now, spool, tables, n, centre)
                    now, spool, tables, held, n = at, None, [], 0, 0
                    centre = tuple(batch.column(batch.schema.get_field_index(c))[a].as_py() for c in origin) or centre
                n, held = n + b - a, held + b - a
                tables.append(pa.Table.from_batches([batch.slice(a, b - a)]))
                if held >= HELD:
                    spool = spool or codecs.Spool(fmt)
                    box = bounds.node(name_of(*at))
                    spool.add(to_numpy(pa.concat_tables(tables).select(keep)), box.low, box.high)
                    tables, held = [tables[-1].slice(0, 0)], 0
        if now is not None:
            yield finish(now, spool, tables, n, centre)

    rows = tiled.select(*key, *dict.fromkeys([*keep, order, *origin]))
    return rows.repartition(*key).sortWithinPartitions(*key, order).mapInArrow(write, WRITTEN)


def read_nodes(spark: SparkSession, folder: str, fmt: str, attributes=None, bounds: G.Bounds | None = None) -> DataFrame:
    """Points of all node files under a folder, with node_idx, node_lvl and node_name.

    Spark lists and reads the files (any store that it knows), tasks decode them.
    """
    extension = check_format(fmt)[0]
    wanted = frozenset(attributes or schema.FORMATS[fmt] - {"NORMAL"}) | {"POSITION"}
    columns = schema.columns_of(wanted)
    root = f"{folder}/ept-data" if fmt.startswith("ENTWINE") else folder

    types = {"double": pa.float64(), "float": pa.float32(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}

    def pieces(data):
        """A file's points, HELD at a time."""
        if fmt in ("LAS", "ENTWINE_LAS"):
            head = codecs.las_header(data)
            at, size, n = head["point_offset"], head["record_length"], head["n_points"]
            for a in range(0, n, HELD):
                yield codecs.decode_las(data[at + a * size : at + min(a + HELD, n) * size], head, wanted)
            return
        if fmt in ("BIN", "BINZ"):
            points, centre = codecs.decode_bin(data, fmt == "BINZ"), (0.0, 0.0, 0.0)
        else:
            points, centre = codecs.decode_pnts(bytes(data))
        for a in range(0, codecs.count(points), HELD):
            part = {c: v[a : a + HELD] for c, v in points.items()}
            if fmt == "3DTILES":
                part |= {c: part[c] + o for c, o in zip("xyz", centre, strict=True)}
            yield part

    def decode(batches):
        for batch in batches:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                for points in pieces(memoryview(data.as_buffer())):
                    n = codecs.count(points)
                    arrays = [pa.array(np.ascontiguousarray(points[c]) if c in points else np.zeros(n)).cast(types[t], safe=False) for c, t in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name, object), pa.string()), *arrays], names=["file", *(c for c, _ in columns)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").load(root)
    files = files.select(F.regexp_extract("path", r"([^/]+)\.[A-Za-z]+$", 1).alias("name"), "content")
    points = files.mapInArrow(decode, "file string, " + ", ".join(f"{c} {t}" for c, t in columns))
    idx, lvl = M.parse_entwine("file") if fmt.startswith("ENTWINE") else M.parse_potree("file")
    named = points.withColumns({"node_idx": idx, "node_lvl": lvl}).drop("file").withColumn("node_name", M.name_potree("node_idx", "node_lvl"))
    return named.where("node_idx IS NOT NULL")


# Descriptors


def write_properties(out: str, bounds: G.Bounds, spacing: float, points: int, prepare_ms: int, indexing_ms: int) -> None:
    """K11"""
    body = {"bounds": {"min": list(bounds.low), "max": list(bounds.high)}, "root_spacing": spacing, "processed_points": points, "prepare_duration": prepare_ms, "indexing_duration": indexing_ms}
    write_whole(f"{out}/properties.json", json.dumps(body, indent=2).encode())


def ept_schema(attributes) -> list[dict]:
    """K9"""
    out = []
    for a in schema.ATTRIBUTES:
        if a.token in attributes:
            for name, size, kind in a.ept:
                out.append({"name": name, "size": size, "type": kind} | ({"scale": 1, "offset": 0} if a.token == "POSITION" else {}))
    return out


def write_ept(out: str, bounds: G.Bounds, tight: G.Bounds, spacing: float, points: int, attributes, srs: str = "", data_type: str = "las") -> None:
    """With the true count, the type of the files that are there, and the span as cells along an axis (K9)."""
    body = {
        "bounds": [*bounds.low, *bounds.high], "boundsConforming": [*tight.low, *tight.high], "dataType": data_type, "hierarchyType": "json", "points": points,
        "schema": ept_schema(attributes), "span": round(bounds.extent / spacing), "srs": {"wkt": srs} if srs else {}, "version": "1.0.0",
    }
    write_whole(f"{out}/ept.json", json.dumps(body).encode())


def write_ept_hierarchy(nodes: DataFrame, out: str, every: int = 5) -> DataFrame:
    """One JSON file per subtree, by tasks; root_name and entries of each (K8)."""

    def write(table: pa.Table) -> pa.Table:
        root = table.column("root_name")[0].as_py()
        entries = dict(sorted(zip(table.column("name").to_pylist(), table.column("n").to_pylist(), strict=True)))
        write_whole(f"{out}/ept-hierarchy/{root}.json", json.dumps(entries).encode())
        return pa.table({"root_name": [root], "entries": [len(entries)]})

    rows = tree.hierarchy(nodes.select("node_idx", "node_lvl", "n"), every)
    named = rows.select(M.name_entwine("root_idx", "root_lvl").alias("root_name"), M.name_entwine("node_idx", "node_lvl").alias("name"), "n")
    return named.groupBy("root_name").applyInArrow(write, "root_name string, entries bigint")


def tile_json(name: str, kids: dict[str, list[str]], with_points: set[str], outside: set[str], bounds: G.Bounds, spacing: float) -> dict:
    box = bounds.node(name)
    c, h = box.centre, [e / 2 for e in box.extents]
    node = {
        "boundingVolume": {"box": [*c, h[0], 0, 0, 0, h[1], 0, 0, 0, h[2]]}, "geometricError": spacing / 2.0 ** (len(name) - 1), "refine": "ADD",
        "children": [tile_json(k, kids, with_points, outside, bounds, spacing) for k in sorted(kids.get(name, []))],
    }
    if name in outside:
        return node | {"content": {"uri": f"{name}.json"}, "children": []}
    return node | ({"content": {"uri": f"{name}.pnts"}} if name in with_points else {})


def write_tilesets(nodes: DataFrame, out: str, bounds: G.Bounds, spacing: float, every: int = 3) -> DataFrame:
    """tileset.json for the root's subtree and r....json for the others, by tasks; ancestors without points included."""
    own = nodes.select("node_idx", "node_lvl").withColumn("has_points", F.lit(True))
    above = tree.ancestors(own).withColumn("has_points", F.lit(False))
    every_node = own.unionByName(above).groupBy("node_idx", "node_lvl").agg(F.max("has_points").alias("has_points"))
    inner = tree.split_subtrees(every_node, every).withColumn("outside", F.lit(False))
    links = inner.where(f"node_lvl > 0 AND node_lvl % {every} = 0").select("node_idx", "node_lvl", "has_points", F.expr(f"shiftright(node_idx, {3 * every})").alias("root_idx"), (F.col("node_lvl") - every).alias("root_lvl"), F.lit(True).alias("outside"))
    rows = inner.unionByName(links).select(M.name_potree("root_idx", "root_lvl").alias("root"), M.name_potree("node_idx", "node_lvl").alias("name"), "has_points", "outside")

    def write(table: pa.Table) -> pa.Table:
        root = table.column("root")[0].as_py()
        kids: dict[str, list[str]] = {}
        points, outside = set(), set()
        for name, has, out_ in zip(*(table.column(c).to_pylist() for c in ("name", "has_points", "outside")), strict=True):
            if name != root:
                kids.setdefault(name[:-1], []).append(name)
            points |= {name} if has else set()
            outside |= {name} if out_ else set()
        body = {"asset": {"version": "0.0"}, "geometricError": spacing, "root": tile_json(root, kids, points, outside, bounds, spacing)}
        write_whole(f"{out}/{'tileset' if root == 'r' else root}.json", json.dumps(body).encode())
        return pa.table({"root": [root], "tiles": [table.num_rows]})

    return rows.groupBy("root").applyInArrow(write, "root string, tiles bigint")


def read_descriptor(folder: str) -> dict:
    """bounds, spacing and naming of a dataset: properties.json, else ept.json, else cloud.js."""
    if exists(f"{folder}/properties.json"):
        d = json.loads(read_whole(f"{folder}/properties.json"))
        return {"bounds": G.Bounds(tuple(d["bounds"]["min"]), tuple(d["bounds"]["max"])), "spacing": d["root_spacing"], "naming": "potree"}
    if exists(f"{folder}/ept.json"):
        d = json.loads(read_whole(f"{folder}/ept.json"))
        b = G.Bounds(tuple(d["bounds"][:3]), tuple(d["bounds"][3:]))
        return {"bounds": b, "spacing": b.extent / int(d["span"]), "naming": "entwine"}
    if exists(f"{folder}/cloud.js"):
        d = json.loads(read_whole(f"{folder}/cloud.js"))
        box = d["boundingBox"]
        return {"bounds": G.Bounds((box["lx"], box["ly"], box["lz"]), (box["ux"], box["uy"], box["uz"])), "spacing": d["spacing"], "naming": "potree"}
    raise FileNotFoundError(f"nothing describes the dataset in {folder}")


def write_dataset(tiled: DataFrame, out: str, fmt: str, bounds: G.Bounds, spacing: float, rgb_from: str = "NONE", tight: G.Bounds | None = None, started: float | None = None) -> DataFrame:
    """All files of a dataset: nodes, hierarchy or tilesets, descriptors; returns the written nodes."""
    from octolith.session import materialize

    began = time.time()
    clear_directory(out)
    nodes = materialize(write_nodes(tiled, out, fmt, bounds, rgb_from), "written")
    points = nodes.agg(F.sum("n")).first()[0] or 0
    if fmt == "3DTILES":
        write_tilesets(nodes, out, bounds, spacing).count()
    if fmt.startswith("ENTWINE"):
        write_ept_hierarchy(nodes, out).count()
        write_ept(out, bounds, tight or bounds, spacing, points, schema.attributes_of(tiled) & schema.FORMATS[fmt])
    write_properties(out, bounds, spacing, points, int(1000 * (began - (started or began))), int(1000 * (time.time() - began)))
    return nodes

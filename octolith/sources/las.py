"""LAS as a Spark data source, with header-only catalogs and splits inside files.

    spark.dataSource.register(LasSource)
    spark.read.format("las").option("path", "a.las,dir").option("columns", "x,y,z").load()
    spark.read.format("las").option("path", ...).option("header", "true").load()   # a row per file

Options: path (files and directories, comma-separated), columns (pruning: Python sources get no pushdown of columns),
splitPoints (points to a partition), ignore (error classes passed over), header.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from octolith import schema
from octolith.schema import IgnoreErrors
from octolith.sources import codecs
from octolith.sources.files import exists, expand, open_fs

SPLIT = 1_000_000
#: Where splits are more than this, partitions take several of them, one after the other.
PARTITIONS = 2000
HEADER_SCHEMA = "file_id int, path string, n_points bigint, point_format int, low_x double, low_y double, low_z double, high_x double, high_y double, high_z double, scale_x double, offset_x double, offset_y double, offset_z double"
TYPES = {"double": pa.float64(), "smallint": pa.int16(), "int": pa.int32(), "tinyint": pa.int8(), "float": pa.float32(), "bigint": pa.int64()}


def read_header(path: str) -> dict:
    fs, p = open_fs(path)
    with fs.open_input_file(p) as f:
        return codecs.las_header(f.read(375))


def input_files(sources: list[str], ignore: IgnoreErrors = IgnoreErrors.NONE) -> list[str]:
    """Existing .las and .laz files among the sources; others are errors unless ignored."""
    present = []
    for s in sources:
        if exists(s):
            present.append(s)
        elif not ignore & IgnoreErrors.MISSING_FILES:
            raise FileNotFoundError(f"no such file: {s}")
    out = []
    for f in expand(present):
        if f.lower().endswith((".las", ".laz")):
            out.append(f)
        elif not ignore & IgnoreErrors.UNSUPPORTED_FILE_FORMAT:
            raise ValueError(f"file format isn't supported: {f}")
    if not out:
        raise ValueError("no files found for processing")
    return out


class Slice:
    def __init__(self, file_id: int, path: str, start: int, count: int):
        self.file_id, self.path, self.start, self.count = file_id, path, start, count


class Slices(InputPartition):
    def __init__(self, slices: list[Slice]):
        self.slices = slices


class LasReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[tuple[str, str]]):
        self.columns = columns
        self.ignore = IgnoreErrors.parse(options.get("ignore", ""))
        self.files = input_files([s.strip() for s in options["path"].split(",")], self.ignore)
        self.split = int(options.get("splitpoints", options.get("splitPoints", SPLIT)))
        self.header = str(options.get("header", "false")).lower() == "true"

    def partitions(self):
        if self.header:
            return [Slices([Slice(i, f, 0, 0)]) for i, f in enumerate(self.files)]
        out = []
        for i, f in enumerate(self.files):
            try:
                n = read_header(f)["n_points"]
            except (OSError, ValueError):
                if not self.ignore & IgnoreErrors.CORRUPTED_FILES:
                    raise
                continue
            out += [Slice(i, f, a, min(self.split, n - a)) for a in range(0, n, self.split)]
        each = -(-len(out) // PARTITIONS)
        return [Slices(out[a : a + each]) for a in range(0, len(out), each or 1)] or [Slices([])]

    def read(self, part: Slices):
        heads: dict[str, dict] = {}
        for piece in part.slices:
            yield from self.read_slice(piece, heads)

    def read_slice(self, part: Slice, heads: dict[str, dict]):
        try:
            if part.path not in heads:
                heads[part.path] = read_header(part.path)
            head = heads[part.path]
            if self.header:
                values = [part.file_id, part.path, head["n_points"], head["point_format"], *head["low"], *head["high"], head["scale"][0], *head["offset"]]
                fields = [x.split() for x in HEADER_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if t == "string" else TYPES[t]) for v, (_, t) in zip(values, fields, strict=True)], names=[n for n, _ in fields])
                return
            fs, p = open_fs(part.path)
            with fs.open_input_file(p) as f:
                f.seek(head["point_offset"] + part.start * head["record_length"])
                data = f.read(part.count * head["record_length"])
            whole = len(data) // head["record_length"]
            if whole < part.count and not self.ignore & IgnoreErrors.CORRUPTED_FILES:
                raise ValueError(f"{part.path} ends before its last point")
            data = data[: whole * head["record_length"]]
        except (OSError, ValueError):
            if not self.ignore & IgnoreErrors.CORRUPTED_FILES:
                raise
            return
        wanted = {c for c, _ in self.columns}
        points = codecs.decode_las(data, head, {a.token for a in schema.ATTRIBUTES if wanted & {c for c, _ in a.columns}})
        points["file_id"] = np.full(whole, part.file_id, np.int32)
        for a in range(0, whole, 100_000):
            arrays = [pa.array(points[c][a : a + 100_000] if c in points else np.zeros(len(points["x"][a : a + 100_000])), TYPES[t]) for c, t in self.columns]
            yield pa.RecordBatch.from_arrays(arrays, names=[c for c, _ in self.columns])


class LasSource(DataSource):
    @classmethod
    def name(cls):
        return "las"

    def _columns(self) -> list[tuple[str, str]]:
        every = [*schema.columns_of(schema.ALL - {"NORMAL"}), ("file_id", "int")]
        wanted = self.options.get("columns")
        if not wanted:
            return every
        names = [c.strip() for c in wanted.split(",")]
        if unknown := set(names) - {c for c, _ in every}:
            raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
        return [(c, dict(every)[c]) for c in names]

    def schema(self):
        if str(self.options.get("header", "false")).lower() == "true":
            return HEADER_SCHEMA
        return ", ".join(f"{c} {t}" for c, t in self._columns())

    def reader(self, schema):
        return LasReader(dict(self.options), self._columns())

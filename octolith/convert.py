"""Batch entry points: tile source files to a dataset, convert a dataset's nodes to another format (2.R, C1-C5)."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith import schema
from octolith.functions import geometry as G
from octolith.functions import srs
from octolith.operators import tiling
from octolith.schema import IgnoreErrors
from octolith.sources import las, nodes
from octolith.sources.files import clear_directory, delete, exists


def tile_files(
    spark: SparkSession, sources: list[str], out: str, output_format: str = "3DTILES", sampling: str = "MIN_DISTANCE", tiling_strategy: str = "FAST", spacing: float = 0.0,
    diagonal_fraction: float = 0.0, max_points_per_node: int = 20_000, max_depth: int | None = None, rgb_from: str = "NONE", source_projection: str | None = None, ignore: str = "NONE",
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The tiler: LAS files to a dataset; returns the written nodes. transform is applied to all points as they are read."""
    started = time.time()
    flags = IgnoreErrors.parse("" if ignore == "NONE" else ignore)
    nodes.check_format(output_format)
    files = las.input_files(sources, flags)
    offered = []
    for f in files:
        try:
            offered.append(schema.las_attributes(las.read_header(f)["point_format"]))
        except (OSError, ValueError):
            if not flags & IgnoreErrors.CORRUPTED_FILES:
                raise
    inputs, _, _ = schema.plan_attributes(offered, output_format, rgb_from)
    spark.dataSource.register(las.LasSource)
    columns = [c for c, _ in schema.columns_of(inputs)]
    reader = spark.read.format("las").option("path", ",".join(files)).option("columns", ",".join([*columns, "file_id"])).option("ignore", " ".join(x.name for x in IgnoreErrors if x in flags and x.name))
    points = reader.load()
    if "point_source_id" in columns:
        points = points.withColumn("point_source_id", F.pmod("file_id", F.lit(65536)).cast("int"))
    if transform is not None:
        points = points.transform(transform)
    points = srs.transform(points, source_projection)
    tight = G.bounds_of(points)
    if output_format == "3DTILES" and tight is not None:  # single precision about the centre loses least
        points = points.withColumns(dict(zip("xyz", G.to_centre_f32(tight.cubic()), strict=True)))
    tie = ["file_id", *columns]  # points that agree in all of these are interchangeable
    tiled, ctx = tiling.tile(points, tie, sampling, tiling_strategy, spacing, diagonal_fraction, max_points_per_node, max_depth)
    return nodes.write_dataset(tiled, out, output_format, ctx.bounds, ctx.spacing, rgb_from, tight, started)


def dataset_format(folder: str) -> str:
    """The format of a dataset's node files, by descriptor and extension."""
    from pyarrow import fs as pafs

    from octolith.sources.files import open_fs

    for sub, suffixes in (("ept-data", {".las": "ENTWINE_LAS"}), ("", {".bin": "BIN", ".binz": "BINZ", ".las": "LAS", ".pnts": "3DTILES"})):
        fs, path = open_fs(f"{folder}/{sub}".rstrip("/"))
        if fs.get_file_info(path).type == pafs.FileType.Directory:
            for x in fs.get_file_info(pafs.FileSelector(path)):
                for suffix, fmt in suffixes.items():
                    if x.is_file and x.path.endswith(suffix):
                        return fmt
    raise ValueError(f"no node files in {folder}")


def convert(
    spark: SparkSession, source: str, out: str, output_format: str = "3DTILES", source_projection: str | None = None, max_depth: int | None = None, delete_source: bool = False, attributes: frozenset[str] | None = None
) -> DataFrame:
    """The converter: nodes of a dataset to .pnts with tilesets (C1) or LAS (C2); returns the written nodes.

    Without `attributes` all that the target supports are kept (C5).
    """
    if not exists(source):
        raise FileNotFoundError(f"no such folder: {source}")
    described, fmt = nodes.read_descriptor(source), dataset_format(source)
    wanted = attributes or (schema.FORMATS[fmt] & schema.FORMATS[output_format]) - {"NORMAL"}
    points = nodes.read_nodes(spark, source, fmt, wanted)
    if max_depth is not None:
        points = points.where(F.col("node_lvl") <= max_depth)
    points = srs.transform(points, source_projection)
    if output_format == "3DTILES":  # positions are stored in single precision, about each node's least corner
        points = G.recentre(points, ["node_name"])
    target = out.rstrip("/")
    if target != source.rstrip("/"):
        clear_directory(target)
    from octolith.session import materialize

    written = materialize(nodes.write_nodes(points, target, output_format, described["bounds"]), "converted")
    total = written.agg(F.sum("n")).first()[0] or 0
    if output_format == "3DTILES":
        nodes.write_tilesets(written, target, described["bounds"], 2 * described["spacing"]).count()
    nodes.write_properties(target, described["bounds"], described["spacing"], total, 0, 0)
    if delete_source:
        gone = [nodes.path_of(source, fmt, r["node_name"]) for r in written.select("node_name").toLocalIterator()]
        delete([p for p in gone if exists(p)])
    return written


def reproject_tiles(spark: SparkSession, source: str, out: str, projection: str, recentre: bool = True) -> DataFrame:
    """.pnts files with their centres added, in geocentric coordinates, about each node's least corner."""
    from octolith.session import materialize

    described = nodes.read_descriptor(source)
    points = srs.transform(nodes.read_nodes(spark, source, "3DTILES", {"RGB", "INTENSITY"}), projection)
    if recentre:
        points = G.recentre(points, ["node_name"])
    return materialize(nodes.write_nodes(points, out, "3DTILES", described["bounds"]), "reprojected")

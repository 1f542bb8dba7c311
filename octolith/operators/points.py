"""Operators on point tables: order, chunks, catalog, provenance, distance joins (O, S11, S24, J6, K17)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from octolith.session import materialize


def with_place(df: DataFrame, order: list[str]) -> DataFrame:
    """df with `place`, the row's number in a global order, from 0.

    A range-partitioned sort is written once; partition counts give each part its first number, so that no task sees more
    than its part. The order has to be total.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def count(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())], names=[*batch.schema.names, "__part", "__nth"])
            at += n

    keys = [F.col(c) for c in order]
    rows = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(count, f"{fields}, __part bigint, __nth bigint"), "ordered")
    parts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    before = parts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return rows.join(before, "__part").withColumn("place", F.col("__before") + F.col("__nth")).drop("__part", "__nth", "__before")


def chunks(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """df with `chunk`: k runs of equal length, the last with what is left over."""
    placed = with_place(df, order)
    size = max(1, df.count() // k)
    return placed.withColumn("chunk", F.least(F.expr(f"place DIV {size}"), F.lit(k - 1))).drop("place")


def merge_sorted(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Union of sorted parts in order: the shuffle of a sort merges them."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(*order)


def partition_with_jumps(df: DataFrame, run: Column, order: list[str]) -> DataFrame:
    """df with `selected`: the first row of each run of equal values; both halves keep their order."""
    return df.withColumn("selected", F.row_number().over(Window.partitionBy(run).orderBy(*order)) == 1)


def catalog(points: DataFrame, file: str) -> DataFrame:
    """Per file the count and tight bounds."""
    return points.groupBy(file).agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{n}_{a}") for n, f in (("low", F.min), ("high", F.max)) for a in "xyz"])


def stamp_source(points: DataFrame, file: str) -> DataFrame:
    """The index of the input file as point source, in 16 bits."""
    return points.withColumn("point_source_id", F.pmod(F.col(file), F.lit(65536)).cast("int"))


def node_files(paths: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Node files among paths, by extension and depth of their name."""
    from octolith.operators import tree

    found = paths.where(F.lower("path").rlike(r"\.(las|laz|bin|binz|pnts)$"))
    nodes = tree.from_names(found, "path")
    return nodes if max_depth is None else nodes.where(F.col("node_lvl") <= max_depth)


def broken_nodes(nodes: DataFrame, level: int = 16, share: float = 0.01) -> DataFrame:
    """Deep nodes that took hardly any of their points (K17). nodes: total, taken."""
    return nodes.where((F.col("node_lvl") >= level) & (F.col("taken") / F.col("total") < share))


def _cells(df: DataFrame, edge: float) -> DataFrame:
    return df.withColumns({f"c{a}": F.floor(F.col(a) / edge).cast("bigint") for a in "xyz"})


def distance_join(df: DataFrame, key: str, spacing: float, square: float | None = None) -> DataFrame:
    """Pairs (a < b) closer than the spacing: rows meet in cells of that size and their 26 neighbours."""
    cells = _cells(df, spacing)
    steps = [F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias(s) for s in ("i", "j", "k")]
    near = cells.select(F.col(key).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"), "cx", "cy", "cz")
    for s, c in zip(steps, ("cx", "cy", "cz"), strict=True):
        near = near.select("*", s)
        near = near.withColumn(c, F.col(c) + F.col(near.columns[-1])).drop(near.columns[-1])
    other = cells.select(F.col(key).alias("b"), "x", "y", "z", "cx", "cy", "cz")
    d = sum(((F.col(f"a{a}") - F.col(a)) * (F.col(f"a{a}") - F.col(a)) for a in "yz"), (F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")))
    return near.join(other, ["cx", "cy", "cz"]).where((F.col("a") < F.col("b")) & (d < (square if square is not None else spacing * spacing))).select("a", "b")


def spacing_violations(marked: DataFrame, spacing: float, tie: list[str]) -> DataFrame:
    """Of a distance sample: pairs of selected points that are too close, and points left out that no selected one is close to."""
    import numpy as np

    square = float(np.float32(spacing) * np.float32(spacing))
    keyed = marked.withColumn("__id", F.struct(*tie)).select("__id", "x", "y", "z", "selected")
    chosen = _cells(keyed.where("selected"), spacing)
    around = chosen
    for c in ("cx", "cy", "cz"):
        around = around.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    around = around.select(F.col("__id").alias("s"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), "cx", "cy", "cz")
    d = sum(((F.col(f"s{a}") - F.col(a)) * (F.col(f"s{a}") - F.col(a)) for a in "yz"), (F.col("sx") - F.col("x")) * (F.col("sx") - F.col("x")))
    close = _cells(keyed, spacing).join(around, ["cx", "cy", "cz"]).where(d < square)
    pairs = close.where("selected AND s > __id").agg(F.count(F.lit(1)).alias("violations"))
    covered = close.select("__id").distinct()
    left = keyed.where("NOT selected").join(covered, "__id", "left_anti").agg(F.count(F.lit(1)).alias("addable"))
    return pairs.withColumn("k", F.lit(0)).join(left.withColumn("k", F.lit(0)), "k").drop("k")

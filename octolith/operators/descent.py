"""The levels of whole subtrees in one pass (TA5, TA7, TA8, ST1-ST3).

A level at a time, every point that isn't placed yet would be dealt and written once a level. Here points are dealt once, by
subtrees: a task holds a subtree's points in key order and takes them through all levels with numpy. The picks are those of
Sampler.mark(): the first point of each cell by distance, key and tie columns.

A subtree's root is chosen from counts so that this is exact without looking beyond the subtree: cells of the first level
are no larger than the root, and all nodes above it hold so many points that they can't be taken whole, however many
points the levels above have taken from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolith.functions import geometry as G
from octolith.functions import morton as M
from octolith.operators.samplers import Context, Sampler

#: Points that a subtree should have at most, where it can be split, and points that a task may hold.
SUBTREE, HELD = 250_000, 4_000_000
#: The level of points that have none yet.
NEW = -2


def shift_of(level: int) -> int:
    return 3 * (M.LEVELS - 1 - level)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys start, and their lengths."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return starts, np.diff(starts, append=len(keys))


def first_of_runs(cells: np.ndarray, distance: np.ndarray | None) -> np.ndarray:
    """The first row of every run, or the first of those at the least distance."""
    out = np.zeros(len(cells), bool)
    starts, lengths = runs(cells)
    if distance is None:
        out[starts] = True
        return out
    distance = np.where(np.isnan(distance), np.inf, distance)
    hits = np.flatnonzero(distance == np.repeat(np.minimum.reduceat(distance, starts), lengths))
    run = np.repeat(np.arange(len(starts)), lengths)[hits]
    out[hits[np.concatenate([[True], run[1:] != run[:-1]])]] = True
    return out


def levels_of(morton: np.ndarray, xyz: np.ndarray, root: np.ndarray, first: int, last: int, ctx: Context, how: Sampler, old: np.ndarray | None = None) -> np.ndarray:
    """The level of each point of whole subtrees, rows in key and tie order; root: the node level of each row's subtree.

    old: the level where a point is stored, NEW for points that arrive. Nodes that something arrives at are sampled anew.
    """
    out = np.full(len(morton), NEW, np.int8) if old is None else old.copy()
    rest = np.flatnonzero(out == NEW)
    for level in range(first, last + 1):
        if not len(rest):
            break
        pool, shift = rest, shift_of(level)
        if old is not None:
            mine = np.flatnonzero(old == level)
            mine = mine[np.isin(morton[mine] >> shift, np.unique(morton[rest] >> shift))]
            pool = np.sort(np.concatenate([rest, mine]))
        if level == last or not how.supports(level, ctx):
            out[pool] = level
            break
        keys = morton[pool]
        starts, lengths = runs(keys >> shift)
        whole = lengths <= ctx.max_points
        if old is not None:
            whole &= ~np.logical_or.reduceat(old[pool] == level, starts)
        take = np.repeat(whole, lengths) & (level >= root[pool] - 1)
        take |= first_of_runs(how.cells(keys, level, ctx), how.distances(keys, xyz[pool], level, ctx))
        out[pool[take]] = level
        rest = pool[~take]
    return out


@dataclass
class Plan:
    """Subtrees of a set of points: prefixes of `depth` octants with their subtree's root level and bucket."""

    depth: int
    table: pa.Table  # __p, __root, __bucket
    buckets: int
    hot: list[int]  # prefixes with more points than a task may hold


def deepest_root(first: int, ctx: Context) -> int:
    """Octants that a subtree's root may have: cells of the first level aren't larger, and counts stay few."""
    c = G.candidate_level(ctx.bounds.extent, G.spacing_at(ctx.spacing, first))
    return min(max(c, first) + 1, max(6, first + 4), M.LEVELS)


def plan(points: DataFrame, first: int, ctx: Context, old: bool = False) -> Plan:
    """Subtrees from one aggregation. With old, points have __old, the level where they are stored or NEW."""
    depth = deepest_root(first, ctx)
    by = [M.node_of(F.col("morton"), depth).alias("p"), (F.col("__old") if old else F.lit(NEW)).alias("old")]
    found = sorted((r["p"], r["old"], r["n"]) for r in points.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect())
    p, at, n = (np.array([r[k] for r in found], np.int64) for k in range(3))
    wanted = min(SUBTREE, max(20_000, int(n.sum()) // (4 * points.sparkSession.sparkContext.defaultParallelism)))
    root = np.full(len(p), -1)
    for j in range(depth + 1):
        _, node = np.unique(p >> 3 * (depth - j), return_inverse=True)
        size = np.bincount(node, n)[node]
        fresh, held = np.bincount(node, n * (at == NEW))[node], np.bincount(node, at >= j - 1)[node] > 0
        taken = sum(8 ** max(0, G.candidate_level(ctx.bounds.extent, G.spacing_at(ctx.spacing, level)) + 1 - j) for level in range(first, j - 1))
        split = (size > wanted) & ((j <= first) | (fresh - taken > ctx.max_points) | held) if j < depth else np.zeros(len(p), bool)
        root[(root < 0) & ~split] = j
    p, at = np.unique(p, return_index=True)
    root = root[at]
    size = np.add.reduceat(n, at) if len(at) else n
    _, tree = np.unique(np.stack([p >> 3 * (depth - root), root]), axis=1, return_inverse=True) if len(p) else (None, np.zeros(0, int))
    tree = tree.reshape(-1)
    whole = np.bincount(tree, size)
    bucket = ((np.cumsum(whole) - whole) // max(1, wanted)).astype(np.int64)[tree] if len(p) else np.zeros(0, np.int64)
    hot = p[(root == depth) & (size > HELD)].tolist()
    return Plan(depth, pa.table({"__p": p, "__root": root.astype(np.int32), "__bucket": bucket.astype(np.int32)}), int(bucket.max(initial=0)) + 1, hot)


def place(points: DataFrame, found: Plan, first: int, last: int, ctx: Context, how: Sampler, old: bool = False) -> DataFrame:
    """Points of the plan's subtrees, but for hot ones, with node_idx and node_lvl."""
    spark, columns = points.sparkSession, [c for c in points.columns if c != "__old"]
    table = found.table.filter(~np.isin(found.table["__p"].to_numpy(), found.hot))
    trees = F.broadcast(spark.createDataFrame(table))
    dealt = points.withColumn("__p", M.node_of(F.col("morton"), found.depth)).join(trees, "__p").drop("__p")
    ordered = dealt.repartitionById(found.buckets, "__bucket").drop("__bucket").sortWithinPartitions(*ctx.order())
    names = [*columns, "node_lvl"]

    def run(batches):
        for held in subtrees(batches):
            morton = held["morton"].to_numpy()
            xyz = np.stack([held[c].to_numpy() for c in "xyz"], axis=1)
            level = levels_of(morton, xyz, held["__root"].to_numpy(), first, last, ctx, how, held["__old"].to_numpy().astype(np.int8) if old else None)
            out = held.select(columns).append_column("node_lvl", pa.array(level.astype(np.int32) + 1))
            yield from out.select(names).to_batches(max_chunksize=50_000)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields if f.name != "__old")
    placed = ordered.mapInArrow(run, f"{fields}, node_lvl int")
    return placed.select(*columns, M.shr(F.col("morton"), F.lit(3 * M.LEVELS) - F.col("node_lvl") * 3).alias("node_idx"), "node_lvl")


def subtrees(batches: Iterator[pa.RecordBatch], enough: int = 100_000) -> Iterator[pa.Table]:
    """Batches in key order as tables of whole subtrees."""

    def code(batch, row):
        key, root = (batch.column(batch.schema.get_field_index(c))[row].as_py() for c in ("morton", "__root"))
        return root, key >> 3 * (M.LEVELS - root)

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= enough and code(held[0], 0) != code(batch, batch.num_rows - 1):
            table = pa.Table.from_batches(held)
            root = table["__root"].to_numpy()
            key = table["morton"].to_numpy() >> 3 * (M.LEVELS - root.astype(np.int64))
            cut = int(np.flatnonzero((key != key[-1]) | (root != root[-1]))[-1]) + 1
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            size = table.num_rows - cut
    if size:
        yield pa.Table.from_batches(held)

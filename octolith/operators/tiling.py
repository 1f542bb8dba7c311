"""Tiling: points to the nodes of a multi-resolution octree (TA1-TA14, O6, O7, Q8, Q9, Q12).

ACCURATE goes down from the root, a level at a time over the whole dataset: points that represent their node at this level
stay there, the rest go on. Every point is stored once.

FAST starts at a deeper level, whose nodes are independent, and rebuilds the levels above afterwards from samples of their
children, as copies.

A level costs one shuffle by cell (grid samplers) or node (distance samplers) and is written to the shared folder before
the next one starts. Node counts are aggregated before they are joined back, so that a crowded node is no hot key.
"""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from octolith.functions import geometry as G
from octolith.functions import morton as M
from octolith.operators import descent
from octolith.operators.samplers import Context, Greedy, GridFirst, GridSampler, Sampler, sampler, with_keys
from octolith.session import materialize

MAX_LEVEL, LARGE, MIN_START, MAX_START = 20, 100_000, 3, 6


def mark_level(df: DataFrame, level: int, ctx: Context, how: Sampler, adhere: DataFrame | bool = False, last: bool = False) -> DataFrame:
    """df with `selected` for a level (TA1, TA2).

    Nodes of max_points or fewer are taken whole; adhere=True switches that off, and a DataFrame (node) does so for the
    nodes in it, which held points before. At the last level, or where keys are too short, all points are taken.
    """
    if last or not how.supports(level, ctx):
        return df.withColumn("selected", F.lit(True))
    if adhere is True:
        return how.mark(df, level, ctx)
    node = M.node_of(F.col("morton"), level + 1)
    counts = df.groupBy(node.alias("__n")).agg((F.count(F.lit(1)) <= ctx.max_points).alias("__all"))
    if adhere is not False:
        old = adhere.select(F.col("node").alias("__n")).distinct().withColumn("__old", F.lit(True))
        counts = counts.join(old, "__n", "left").select("__n", (F.col("__all") & F.col("__old").isNull()).alias("__all"))
    sized = df.withColumn("__n", node).join(counts, "__n").drop("__n")
    if isinstance(how, Greedy):  # small nodes don't go through Python
        small = sized.where("__all").drop("__all").withColumn("selected", F.lit(True))
        return small.unionByName(how.mark(sized.where("NOT __all").drop("__all"), level, ctx))
    marked = how.mark(sized, level, ctx)
    return marked.withColumn("selected", F.col("selected") | F.col("__all")).drop("__all")


def _stored(df: DataFrame, level: int) -> DataFrame:
    return df.withColumns({"node_idx": M.node_of(F.col("morton"), level + 1), "node_lvl": F.lit(level + 1)})


def descend(points: DataFrame, ctx: Context, how: Sampler, first: int = -1, max_level: int = MAX_LEVEL) -> DataFrame:
    """Points with node_idx and node_lvl, from a level downwards (TA4, TA5, TA7).

    Grid samplers take subtrees through all levels in one pass (descent.py).
    """
    if isinstance(how, GridSampler):
        return _descend_subtrees(points, ctx, how, first, max_level)
    out, rest, columns = None, points, points.columns
    for level in range(first, max_level + 1):
        marked = materialize(mark_level(rest, level, ctx, how, last=level == max_level), f"level{level}")
        kept = _stored(marked.where("selected").select(*columns), level)
        out = kept if out is None else out.unionByName(kept)
        rest = marked.where("NOT selected").select(*columns)
        if rest.isEmpty():
            break
    return out


def _descend_subtrees(points: DataFrame, ctx: Context, how: GridSampler, first: int, max_level: int) -> DataFrame:
    """Subtrees that a task can hold go down in it; larger ones lose one level's picks (or several) and are split anew."""
    columns, rest, level, parts, rows = points.columns, points, first, [], None
    while level < max_level and how.supports(level, ctx):
        found = descent.plan(rest, level, ctx)
        parts.append(materialize(descent.place(rest.select(*columns), found, level, max_level, ctx, how), f"level{level}"))
        if not found.hot:
            return reduce(DataFrame.unionByName, parts)
        prefix = M.node_of(F.col("morton"), found.depth)
        hot = F.broadcast(points.sparkSession.createDataFrame([(p,) for p in found.hot], "__p bigint"))
        rest = rest.withColumn("__p", prefix).join(hot, "__p", "left_semi").drop("__p")
        if rows is None:
            rows = rest = materialize(rest.withColumn("__row", F.monotonically_increasing_id()), "crowded")
        many, depth = _single_cells(rest, prefix, level, max_level, ctx) if isinstance(how, GridFirst) else (0, 0)
        if many:  # levels that see all points of such a node in one cell: they take the first, the second and so on
            nth = F.row_number().over(Window.partitionBy("__p").orderBy(*ctx.order()))
            picks = _lowest(rest.withColumn("__p", prefix), many, min(depth + 4, M.LEVELS)).withColumn("__nth", nth).where(F.col("__nth") <= many).withColumn("node_lvl", F.col("__nth") + F.lit(level))
        else:
            many, picks = 1, how.mark(rest, level, ctx).where("selected").withColumn("node_lvl", F.lit(level + 1))
        picks = materialize(picks.select(*columns, "__row", "node_lvl"), f"crowded{level}")
        parts.append(picks.select(*columns, M.shr(F.col("morton"), F.lit(3 * M.LEVELS) - F.col("node_lvl") * 3).alias("node_idx"), "node_lvl"))
        rest = rest.join(F.broadcast(picks.select("__row")), "__row", "left_anti")
        level += many
    return reduce(DataFrame.unionByName, [*parts, _stored(rest.select(*columns), level)])


def _lowest(df: DataFrame, many: int, depth: int) -> DataFrame:
    """Rows of each __p among which are its lowest by key, as many at least: those up to a cell, by counts of cells."""
    cell = M.node_of(F.col("morton"), depth)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__p").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = df.groupBy("__p", cell.alias("__c")).agg(F.count(F.lit(1)).alias("n")).withColumn("__before", before)
    upto = counts.where(F.col("__before") < many).groupBy("__p").agg(F.max("__c").alias("__upto"))
    return df.join(F.broadcast(upto), "__p").where(cell <= F.col("__upto")).drop("__upto")


def _single_cells(df: DataFrame, prefix: Column, level: int, max_level: int, ctx: Context) -> tuple[int, int]:
    """How many levels on from this one see all points of each prefix in one cell, and how many octants those points share."""
    depth = M.LEVELS
    for r in df.groupBy(prefix.alias("p")).agg(F.min("morton").alias("a"), F.max("morton").alias("b")).collect():
        depth = min(depth, M.LEVELS - -(-(r["a"] ^ r["b"]).bit_length() // 3))
    many = 0
    while level + many < max_level:
        c = G.candidate_level(ctx.bounds.extent, G.spacing_at(ctx.spacing, level + many))
        if max(c, level + many) + 1 > depth or c >= M.LEVELS:
            break
        many += 1
    return many, depth


def prefix_counts(keyed: DataFrame, lvl: int = MAX_START) -> DataFrame:
    """node_idx, n at a level: 8^6 rows at most for the default one (Q3)."""
    return keyed.groupBy(M.node_of(F.col("morton"), lvl).alias("node_idx")).agg(F.count(F.lit(1)).alias("n"))


def start_scores(keyed: DataFrame, large: int = LARGE) -> DataFrame:
    """lvl, ranges, large_ranges for levels 1 to 6 from one aggregation (Q9)."""
    levels = prefix_counts(keyed).withColumn("lvl", F.explode(F.sequence(F.lit(1), F.lit(MAX_START))))
    nodes = levels.groupBy("lvl", F.expr(f"shiftright(node_idx, 3 * ({MAX_START} - lvl))").alias("idx")).agg(F.sum("n").alias("n"))
    return nodes.groupBy("lvl").agg(F.count(F.lit(1)).alias("ranges"), F.count_if(F.col("n") >= large).alias("large_ranges"))


def start_level(keyed: DataFrame, k: int | None = None, large: int = LARGE) -> int:
    """The first level with as many large nodes as workers, 3 at least and 6 if there is none (TA9)."""
    k = k or keyed.sparkSession.sparkContext.defaultParallelism
    for r in sorted(start_scores(keyed, large).collect(), key=lambda r: r["lvl"]):
        if r["ranges"] > k // 2 and r["large_ranges"] / k >= 1:
            return max(r["lvl"], MIN_START)
    return MAX_START


def balanced_start_nodes(keyed: DataFrame, k: int) -> list[tuple[int, int, int]]:
    """(idx, lvl, points): the largest node is split until there are k, on counts of 8^6 prefixes at most (TA13, O11)."""
    leaves = {r["node_idx"]: r["n"] for r in prefix_counts(keyed).collect()}
    sums: list[dict[int, int]] = [{} for _ in range(MAX_START + 1)]
    for idx, n in leaves.items():
        for lvl in range(MAX_START + 1):
            key = idx >> 3 * (MAX_START - lvl)
            sums[lvl][key] = sums[lvl].get(key, 0) + n
    heap, done = [(-n, 0, idx) for idx, n in sums[0].items()], []
    while heap and len(heap) + len(done) < k:
        n, lvl, idx = heapq.heappop(heap)
        if lvl == MAX_START:
            done.append((n, lvl, idx))
            continue
        for c in range(8 * idx, 8 * idx + 8):
            if c in sums[lvl + 1]:
                heapq.heappush(heap, (-sums[lvl + 1][c], lvl + 1, c))
    return sorted((idx, lvl, -n) for n, lvl, idx in heap + done)


def reconstruct(stored: DataFrame, start: int, ctx: Context, how: Sampler) -> DataFrame:
    """Copies for the levels above a start level, each sampled from its children's points (TA12)."""
    columns = [c for c in stored.columns if c not in ("node_idx", "node_lvl")]
    current, out = stored.where(F.col("node_lvl") == start).select(*columns), None
    for level in range(start - 2, -2, -1):
        current = materialize(mark_level(current, level, ctx, how, adhere=True).where("selected").select(*columns), f"up{level}")
        kept = _stored(current, level)
        out = kept if out is None else out.unionByName(kept)
    return out if out is not None else stored.limit(0)


def tile(
    points: DataFrame,
    tie: list[str],
    sampling: str = "MIN_DISTANCE",
    strategy: str = "FAST",
    spacing: float = 0.0,
    diagonal_fraction: float = 0.0,
    max_points_per_node: int = 20_000,
    max_depth: int | None = None,
    start: int | None = None,
    workers: int | None = None,
    bounds: G.Bounds | None = None,
) -> tuple[DataFrame, Context]:
    """Points with morton, node_idx, node_lvl and node_name, and the context they were tiled in (TA7, TA8).

    diagonal_fraction wins over spacing; without both it is 250.
    """
    box = bounds or G.bounds_of(points)
    if box is None:
        empty = points.withColumns({"morton": F.lit(0).cast("bigint"), "node_idx": F.lit(0).cast("bigint"), "node_lvl": F.lit(0), "node_name": F.lit("r")})
        return empty, Context(G.Bounds((0, 0, 0), (0, 0, 0)), spacing, max_points_per_node, tuple(tie))
    cube = box.cubic()
    if diagonal_fraction or not spacing:
        spacing = G.spacing_from_diagonal(cube, diagonal_fraction or 250.0)
    G.check_spacing(cube, spacing)
    ctx, how = Context(cube, spacing, max_points_per_node, tuple(tie)), sampler(sampling)
    keyed = with_keys(points, cube)
    last = min(MAX_LEVEL, (max_depth or 100) - 1)
    if strategy == "ACCURATE":
        out = descend(keyed, ctx, how, max_level=last)
    elif strategy == "FAST":
        start = min(start or start_level(keyed, workers), last + 1)
        low = descend(keyed, ctx, how, first=start - 1, max_level=last)
        out = low.unionByName(reconstruct(low, start, ctx, how))
    else:
        raise ValueError(f"unknown tiling strategy {strategy!r}")
    return out.withColumn("node_name", M.name_potree("node_idx", "node_lvl")), ctx


def tile_deep(points: DataFrame, tie: list[str], depth: int, **options) -> DataFrame:
    """Trees deeper than a key: nodes at level 21 that are too full become roots of their own (TA6).

    Levels stay relative to each such root; names run on. Every point is stored once.
    """
    stored, ctx = tile(points, tie, strategy="ACCURATE", max_depth=min(depth, M.LEVELS), **options)
    crowded = stored.groupBy("node_name").count().where((F.col("count") > ctx.max_points) & (F.length("node_name") > M.LEVELS)).collect() if depth > M.LEVELS else []
    if len(crowded) > 1000:
        raise ValueError("too many crowded nodes at the deepest level: choose a larger spacing or capacity")
    out = stored
    for r in crowded:
        name = r["node_name"]
        own = out.where(F.col("node_name") == name).select(*points.columns)
        sub = tile_deep(own, tie, depth - M.LEVELS, **(options | {"bounds": ctx.bounds.node(name), "spacing": G.spacing_at(ctx.spacing, M.LEVELS - 1), "diagonal_fraction": 0.0}))
        sub = sub.withColumn("node_name", F.concat(F.lit(name), F.substring("node_name", 2, 1000)))
        out = out.where(F.col("node_name") != name).unionByName(sub)
    return out


# Node reports


def node_report(stored: DataFrame) -> DataFrame:
    return stored.groupBy("node_idx", "node_lvl").agg(F.count(F.lit(1)).alias("n"))


def children_of(nodes: DataFrame, bounds: G.Bounds, spacing: Column) -> DataFrame:
    """The eight children of each node: key, name, bounds and half the spacing."""
    kids = nodes.withColumn("octant", F.explode(F.sequence(F.lit(0), F.lit(7))))
    kids = kids.select(M.child(F.col("node_idx"), F.col("node_lvl"), F.col("octant")).alias("node_idx"), (F.col("node_lvl") + 1).alias("node_lvl"), (spacing / 2).alias("spacing"))
    low = G.node_low(F.col("node_idx"), F.col("node_lvl"), bounds)
    size = G.node_extent(F.col("node_lvl"), bounds)
    return kids.select("node_idx", "node_lvl", M.name_potree("node_idx", "node_lvl").alias("node_name"), *(c.alias(f"low_{a}") for a, c in zip("xyz", low, strict=True)), size.alias("extent"), "spacing")


def dropped(points: DataFrame, stored: DataFrame) -> DataFrame:
    """total, stored and dropped counts (Q12)."""
    a, b = points.agg(F.count(F.lit(1)).alias("total")), stored.agg(F.count(F.lit(1)).alias("stored"))
    both = a.withColumn("k", F.lit(0)).join(b.withColumn("k", F.lit(0)), "k")
    return both.select("total", "stored", (F.col("total") - F.col("stored")).alias("dropped"))

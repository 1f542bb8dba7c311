"""Operators on trees of nodes: DataFrames keyed by node_idx and node_lvl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolith.functions import morton as M

KEY = ["node_idx", "node_lvl"]


def ancestors(nodes: DataFrame) -> DataFrame:
    """All proper ancestors of the nodes, once each."""
    up = nodes.where("node_lvl > 0").withColumn("lvl", F.explode(F.expr("sequence(0, greatest(node_lvl - 1, 0))")))
    return up.select(F.expr("shiftright(node_idx, 3 * (node_lvl - lvl))").alias("node_idx"), F.col("lvl").alias("node_lvl")).distinct()


def densify(nodes: DataFrame) -> DataFrame:
    """The nodes with all ancestors and all siblings: each node then has none or eight children.

    Nodes that were not there have nulls in the other columns.
    """
    above = ancestors(nodes)
    kids = above.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(7)))).select(F.expr("shiftleft(node_idx, 3) | o").alias("node_idx"), (F.col("node_lvl") + 1).alias("node_lvl"))
    keys = above.union(kids).union(nodes.select(*KEY)).distinct()
    return keys.join(nodes, KEY, "left")


def erase(nodes: DataFrame, idx: int, lvl: int) -> DataFrame:
    """Without a node's descendants; its own contents become null."""
    low, high = idx << 3 * (M.LEVELS - lvl), (idx + 1) << 3 * (M.LEVELS - lvl)
    first = M.to_static("node_idx", "node_lvl")
    kept = nodes.where(~((F.col("node_lvl") > lvl) & (first >= F.lit(low)) & (first < F.lit(high)) if lvl else F.col("node_lvl") > 0))
    own = (F.col("node_idx") == idx) & (F.col("node_lvl") == lvl)
    return kept.select(*KEY, *[F.when(~own, F.col(c)).alias(c) for c in nodes.columns if c not in KEY])


def at(nodes: DataFrame, idx: int, lvl: int) -> DataFrame:
    """T3"""
    return nodes.where((F.col("node_idx") == idx) & (F.col("node_lvl") == lvl))


def with_parent_key(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_lvl > 0").withColumns({"parent_idx": F.shiftright("node_idx", 3), "parent_lvl": F.col("node_lvl") - 1})


def children(nodes: DataFrame) -> DataFrame:
    """Pairs of parent and child that both exist."""
    kids = with_parent_key(nodes).select(F.col("parent_idx").alias("node_idx"), F.col("parent_lvl").alias("node_lvl"), F.col("node_idx").alias("child_idx"))
    return nodes.select(*KEY).join(kids, KEY)


def siblings(nodes: DataFrame) -> DataFrame:
    """Pairs of different nodes with one parent (T4); eight nodes share a parent at most."""
    a = with_parent_key(nodes).select("parent_idx", "parent_lvl", "node_idx", "node_lvl")
    b = a.select("parent_idx", "parent_lvl", F.col("node_idx").alias("sibling_idx"))
    return a.join(b, ["parent_idx", "parent_lvl"]).where("node_idx <> sibling_idx").select("node_idx", "node_lvl", "sibling_idx")


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes without children."""
    parents = with_parent_key(nodes).select(F.col("parent_idx").alias("node_idx"), F.col("parent_lvl").alias("node_lvl")).distinct()
    return nodes.join(parents, KEY, "left_anti")


def existing(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of the nodes that are wanted."""
    return nodes.join(wanted.select(*KEY), KEY, "left_semi")


def level_order(nodes: DataFrame) -> DataFrame:
    """From the root down, by key within a level (T5)."""
    return nodes.orderBy("node_lvl", "node_idx")


def pre_order(nodes: DataFrame) -> DataFrame:
    """A node before its descendants, depth first (T5)."""
    return nodes.orderBy(M.name_potree("node_idx", "node_lvl"))


def merge(a: DataFrame, b: DataFrame, combine: dict[str, Column] | None = None) -> DataFrame:
    """Nodes of either tree; columns of `combine` are expressions over a.c and b.c, others the first non-null."""
    a, b = a.alias("a"), b.alias("b")
    joined = a.join(b, [F.col("a.node_idx") == F.col("b.node_idx"), F.col("a.node_lvl") == F.col("b.node_lvl")], "full_outer")
    names = [c for c in a.columns if c in b.columns]
    value = lambda c: (combine or {}).get(c, F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")))
    return joined.select(*[value(c).alias(c) for c in names])


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one tree has; none if they are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).union(b.select(*a.columns).exceptAll(a).withColumn("side", F.lit("b")))


def sum_children(nodes: DataFrame, value: str = "n") -> DataFrame:
    """Per parent the sum over its children (Q8)."""
    return with_parent_key(nodes).groupBy("parent_idx", "parent_lvl").agg(F.sum(value).alias(value))


def subtree_root(every: int) -> tuple[Column, Column]:
    """Root of the subtree that a node is in, if trees are cut every so many levels."""
    off = F.col("node_lvl") % every
    return F.expr(f"shiftright(node_idx, 3 * (node_lvl % {every}))"), F.col("node_lvl") - off


def split_subtrees(nodes: DataFrame, every: int) -> DataFrame:
    idx, lvl = subtree_root(every)
    return nodes.withColumns({"root_idx": idx, "root_lvl": lvl})


def hierarchy(nodes: DataFrame, every: int = 5) -> DataFrame:
    """Rows of hierarchy files: subtree, node and its count, -1 for a node whose subtree has a file of its own."""
    own = split_subtrees(nodes, every)
    links = own.where(f"node_lvl > 0 AND node_lvl % {every} = 0").select(F.expr(f"shiftright(node_idx, {3 * every})").alias("root_idx"), (F.col("node_lvl") - every).alias("root_lvl"), "node_idx", "node_lvl", F.lit(-1).cast("bigint").alias("n"))
    return own.select("root_idx", "root_lvl", "node_idx", "node_lvl", "n").unionByName(links)


def from_names(names: DataFrame, column: str = "node_name") -> DataFrame:
    """Nodes of file names r...; other names are left out."""
    idx, lvl = M.parse_potree(F.regexp_extract(F.col(column), r"([^/]*?)(\.[A-Za-z]+)?$", 1))
    return names.withColumns({"node_idx": idx, "node_lvl": lvl}).where("node_idx IS NOT NULL")


def graphviz(nodes: DataFrame, label: Column | None = None) -> DataFrame:
    """Lines of a digraph: a node each, and an edge to its parent."""
    name = M.name_potree("node_idx", "node_lvl")
    text = label if label is not None else name
    own = nodes.select(F.concat(F.lit('"'), name, F.lit('" [label="'), text, F.lit('"];')).alias("line"))
    up = M.name_potree(F.shiftright("node_idx", 3), F.col("node_lvl") - 1)
    edges = nodes.where("node_lvl > 0").select(F.concat(F.lit('"'), up, F.lit('" -> "'), name, F.lit('";')).alias("line"))
    return own.union(edges)

"""Connected components of a large graph by alternating large-star and small-star rounds.

Every round is two group-by-minimum steps with a join and is written to the shared folder, so that lineage stays short
and a lost executor repeats one round at most. The driver sees counts and one checksum a round, never links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolith.session import materialize, release


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """The step's edges, and the table it reads. edges (u, v). Large: each node's greater neighbours move to the least of its neighbours and itself; small: the others."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written, so that the join deals both of its sides and a node with very many neighbours is split at run time.
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    side = both.where("v > u") if large else both.where("v < u")
    moved = side.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct(), least


def components(links: DataFrame) -> DataFrame:
    """links (u BIGINT, v BIGINT) -> node, root (the least node of its component), for every node with a link.

    Rounds go on until nothing changes; their number grows with the square of the logarithm of the nodes at most.
    """
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before, now = None, _checksum(edges)
    while now != before:
        step, first = _star(edges, True)
        step, second = _star(step, False)
        stars, before = materialize(step, "star"), now
        release(edges, first, second)
        edges, now = stars, _checksum(stars)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

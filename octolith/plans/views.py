"""Point views over the driver's tables, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.functions import geometry as G
from octolith.functions import morton as M
from octolith.session import materialize

IDS = ["ok", "ln", "pk", "sk"]
ID_SQL = "ok, ln, pk, sk"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_points(spark: SparkSession, sf_dir: str, attributes: bool = False) -> DataFrame:
    """x, y, z within about 100 units, with a unique tie (ok, ln, pk, sk)."""
    key = [F.col(f"l_{a}").alias(b) for a, b in (("orderkey", "ok"), ("linenumber", "ln"), ("partkey", "pk"), ("suppkey", "sk"))]
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date"))
    more = [
        F.pmod(F.col("l_extendedprice").cast("bigint"), F.lit(65536)).cast("int").alias("intensity"), F.col("l_linenumber").cast("smallint").alias("classification"),
        F.pmod("l_partkey", F.lit(256)).cast("smallint").alias("r"), F.pmod("l_suppkey", F.lit(256)).cast("smallint").alias("g"), F.pmod("l_orderkey", F.lit(256)).cast("smallint").alias("b"),
    ] if attributes else []
    return table(spark, sf_dir, "lineitem").select(*key, (F.col("l_quantity") * 2.0).alias("x"), (F.col("l_extendedprice") / 1050.0).alias("y"), (day / F.lit(25.0)).alias("z"), *more)


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), F.col("label").cast("smallint").alias("classification"))


def keyed(spark: SparkSession, sf_dir: str, attributes: bool = False) -> tuple[DataFrame, G.Bounds]:
    """Points with cell numbers and key, and their cube."""
    pts = lineitem_points(spark, sf_dir, attributes)
    cube = G.bounds_of(pts).cubic()
    cells = {f"q{a}": M.cell(F.col(a), low, cube.extent) for a, low in zip("xyz", cube.low, strict=True)}
    return pts.withColumns(cells).withColumn("morton", M.interleave(F.col("qx"), F.col("qy"), F.col("qz"))), cube


def nodes(spark: SparkSession, sf_dir: str, levels=(1, 3)) -> tuple[DataFrame, G.Bounds]:
    """Node counts at some levels: a tree with gaps.

    Points are read once, for the deepest level. The counts are written out: filters on names made from keys would
    otherwise be pushed below the aggregation, and names be made for every point.
    """
    pts, cube = keyed(spark, sf_dir)
    deepest = max(levels)
    counts = materialize(pts.groupBy(M.node_of(F.col("morton"), deepest).alias("node_idx")).agg(F.count(F.lit(1)).alias("n")), "counts")
    out = None
    for lvl in levels:
        own = counts.groupBy(F.shiftright("node_idx", 3 * (deepest - lvl)).alias("node_idx")).agg(F.sum("n").alias("n")).withColumn("node_lvl", F.lit(lvl))
        out = own if out is None else out.unionByName(own)
    return out.select("node_idx", "node_lvl", "n"), cube


# DuckDB


def spread(v: str) -> str:
    """Bit i to bit 3i, a bit at a time."""
    return "(" + " | ".join(f"((({v}) & {1 << i}) << {2 * i})" for i in range(21)) + ")"


def gather(v: str) -> str:
    return "(" + " | ".join(f"((({v}) >> {2 * i}) & {1 << i})" for i in range(21)) + ")"


PTS = """pts AS (
  SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_quantity * 2.0::DOUBLE AS x, l_extendedprice / 1050.0::DOUBLE AS y,
    date_diff('day', DATE '1995-01-01', l_shipdate::DATE) / 25.0::DOUBLE AS z, (trunc(l_extendedprice)::BIGINT % 65536)::INT AS intensity, l_linenumber AS classification,
    (l_partkey % 256)::INT AS r, (l_suppkey % 256)::INT AS g, (l_orderkey % 256)::INT AS b FROM lineitem)"""
EMB = "emb AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label AS classification FROM embeddings)"


def cube_sql(source: str = "pts") -> str:
    return f"""tight AS (SELECT min(x) AS ax, min(y) AS ay, min(z) AS az, max(x) AS bx, max(y) AS by_, max(z) AS bz FROM {source}),
half AS (SELECT *, greatest(bx - ax, by_ - ay, bz - az) / 2 AS h, ax + (bx - ax) / 2 AS mx, ay + (by_ - ay) / 2 AS my, az + (bz - az) / 2 AS mz FROM tight),
cube AS (SELECT mx - h AS cx, my - h AS cy, mz - h AS cz, (mx + h) - (mx - h) AS e, (my + h) - (my - h) AS ey, (mz + h) - (mz - h) AS ez FROM half)"""


def keyed_sql(source: str = "pts") -> str:
    cell = lambda p: f"least(trunc((greatest({p}, c{p}) - c{p}) * (2097152.0::DOUBLE / e))::BIGINT, 2097151)"
    return f"""{cube_sql(source)},
cells AS (SELECT {source}.*, {cell("x")} AS qx, {cell("y")} AS qy, {cell("z")} AS qz FROM {source}, cube),
keyed AS MATERIALIZED (SELECT *, {spread("qz")} | ({spread("qy")} << 1) | ({spread("qx")} << 2) AS morton FROM cells)"""


KEYED = f"{PTS},\n{keyed_sql()}"
NODES = KEYED + """,
nodes AS (SELECT morton >> 60 AS node_idx, 1 AS node_lvl, count(*) AS n FROM keyed GROUP BY 1
  UNION ALL SELECT morton >> 54, 3, count(*) FROM keyed GROUP BY 1)"""

"""An in-memory node store (K10, S19): DataFrames by node, cached by Spark's block manager."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MemoryStore:
    lossless = True

    def __init__(self):
        self.df: DataFrame | None = None

    def append(self, points: DataFrame) -> None:
        """points with node_name; nodes that exist get more points."""
        points = points.persist(StorageLevel.MEMORY_AND_DISK)
        self.df = points if self.df is None else self.df.unionByName(points)

    def replace(self, points: DataFrame) -> None:
        """Nodes that occur in points get these instead of what they had."""
        old = self.df
        self.df = None
        if old is not None:
            self.append(old.join(points.select("node_name").distinct(), "node_name", "left_anti"))
        self.append(points)

    def nodes(self, *names: str) -> DataFrame:
        if self.df is None:
            raise ValueError("the store is empty")
        return self.df.where(F.col("node_name").isin(*names)) if names else self.df

"""Incremental tiling over Structured Streaming (ST1-ST5).

The state is the points that each node holds, Parquet folders in the shared folder. A batch goes down from the start level:
at each level the nodes it touches are read back, joined to what arrives, sampled anew, and replaced; points that lose their
place go on to the children. With grid samplers state and batch are dealt once, by subtrees, and a task takes a subtree
through all levels (descent.py); where a subtree is too large for that, and with other samplers, a level is done at a time,
and has a folder of its own. Nodes that held points before keep to the spacing even if they are
small. Start level, bounds and spacing are fixed by the first batch; levels above the start level are rebuilt by finish().

What each batch has left, and the tiler's parameters, are written as a manifest after its last level. A tiler on the same
path, in another process perhaps, goes on from the last manifest; a batch that failed half-way has none and is done again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.functions import morton as M
from octolith.operators import descent, tiling
from octolith.operators.samplers import Context, GridSampler, sampler, with_keys
from octolith.session import materialize, release, work_path
from octolith.sources.files import exists, expand, read_whole, write_whole


class IncrementalTiler:
    def __init__(self, spark: SparkSession, ctx: Context, sampling: str = "RANDOM_GRID", start: int = 0, max_level: int = tiling.MAX_LEVEL, path: str | None = None):
        self.spark, self.ctx, self.how, self.start, self.max_level = spark, ctx, sampler(sampling), start, max_level
        self.path = path or work_path(spark, "incremental")
        self.levels: dict[int, DataFrame] = {}
        self.folders: dict[int, str] = {}
        self.whole: str | None = None  # the folder of all levels, if they are in one
        self.done: set[int] = set()
        box = self.ctx.bounds
        self.facts = {"low": list(box.low), "high": list(box.high), "spacing": ctx.spacing, "max_points": ctx.max_points, "tie": list(ctx.tie), "sampling": self.how.name, "start": start, "max_level": max_level}
        self.resume()

    def resume(self) -> None:
        """Take up the state of the last manifest, if there is one; other parameters than its own are an error."""
        folder = f"{self.path}/manifests"
        found = expand([folder]) if exists(folder) else []
        found = sorted((f for f in found if f.endswith(".json")), key=lambda f: int(f.rsplit("-", 1)[1][:-5]))
        if not found:
            return
        state = json.loads(read_whole(found[-1]))
        if state["facts"] != self.facts:
            raise ValueError(f"the tiler in {self.path} was begun with other parameters: {state['facts']}")
        self.done, self.folders = set(state["done"]), {int(k): v for k, v in state["folders"].items()}
        self.whole = state.get("whole")
        self.levels = {k: self.level_of(self.spark.read.parquet(v), k) for k, v in self.folders.items()}

    @staticmethod
    def level_of(df: DataFrame, level: int) -> DataFrame:
        """A level of a folder, which may hold all of them."""
        return df.where(F.col("node_lvl") == level + 1).drop("node_idx", "node_lvl") if "node_lvl" in df.columns else df

    def record(self) -> None:
        """The manifest of the batches done so far."""
        state = {"facts": self.facts, "done": sorted(self.done), "folders": self.folders, "whole": self.whole}
        write_whole(f"{self.path}/manifests/after-{len(self.done):08d}.json", json.dumps(state).encode())

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """foreachBatch function; a batch that was processed already is passed over."""
        if batch_id in self.done:
            return
        rest = materialize(with_keys(batch, self.ctx.bounds), "batch")
        if not (isinstance(self.how, GridSampler) and self.by_subtrees(rest, batch_id)):
            self.by_levels(rest, batch_id)
        release(rest)
        self.done.add(batch_id)
        self.record()

    def by_subtrees(self, rest: DataFrame, batch_id: int) -> bool:
        """State and batch in one pass; False, and nothing done, where a subtree is too large for a task."""
        columns, first = rest.columns, self.start - 1
        both = rest.withColumn("__old", F.lit(descent.NEW))
        if self.levels:
            both = both.unionByName(self.stored().select(*columns, (F.col("node_lvl") - 1).alias("__old")))
        found = descent.plan(both, first, self.ctx, old=True)
        if found.hot:
            return False
        target = f"{self.path}/whole/batch={batch_id}"
        placed = descent.place(both, found, first, self.max_level, self.ctx, self.how, old=True)
        placed.write.mode("overwrite").parquet(target)
        df = self.spark.read.schema(placed.schema).parquet(target)
        self.whole, self.folders = target, dict.fromkeys(range(first, self.max_level + 1), target)
        self.levels = {level: self.level_of(df, level) for level in self.folders}
        return True

    def by_levels(self, rest: DataFrame, batch_id: int) -> None:
        """The nodes that a batch touches, a level at a time."""
        columns, fresh = rest.columns, {}
        for level in range(self.start - 1, self.max_level + 1):
            if rest.isEmpty():
                break
            node = M.node_of(F.col("morton"), level + 1)
            touched = rest.select(node.alias("node")).distinct()
            if level in self.levels:
                old = self.levels[level].withColumn("node", node)
                own = old.join(touched, "node", "left_semi").drop("node")
                aside = old.join(touched, "node", "left_anti").drop("node")
                arriving = rest.unionByName(own.select(*columns))
                marked = tiling.mark_level(arriving, level, self.ctx, self.how, own.select(node.alias("node")), last=level == self.max_level)
            else:
                aside, marked = None, tiling.mark_level(rest, level, self.ctx, self.how, last=level == self.max_level)
            marked = materialize(marked, "marked")
            kept = marked.where("selected").select(*columns)
            target = f"{self.path}/level={level}/batch={batch_id}"
            (kept if aside is None else kept.unionByName(aside.select(*columns))).write.mode("overwrite").parquet(target)
            fresh[level] = self.spark.read.schema(kept.schema).parquet(target)
            self.folders[level] = target
            rest = marked.where("NOT selected").select(*columns)
        self.levels |= fresh
        self.whole = None if fresh else self.whole

    def stored(self) -> DataFrame:
        """Points with node_idx and node_lvl as they are now."""
        if self.whole is not None:
            return self.spark.read.parquet(self.whole)
        out = None
        for level, df in sorted(self.levels.items()):
            own = tiling._stored(df, level)
            out = own if out is None else out.unionByName(own)
        if out is None:
            raise ValueError("no batch has been processed")
        return out

    def finish(self) -> DataFrame:
        """After the last batch: all levels, those above the start level as copies (ST5)."""
        low = self.stored()
        return low.unionByName(tiling.reconstruct(low, self.start, self.ctx, self.how)) if self.start else low


def tile_stream(points: DataFrame, tiler: IncrementalTiler, checkpoint: str, name: str = "tiler"):
    """Run a streaming DataFrame of points through a tiler until it has no more input."""
    query = points.writeStream.queryName(name).foreachBatch(tiler.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query

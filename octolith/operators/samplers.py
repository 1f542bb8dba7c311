"""Samplers: which points of each node represent it.

A sampler marks the rows of all nodes of one level at once. Input: points with `morton`, x, y, z and the tie columns of
the context; output: the same rows with a boolean `selected`. Every order ends with the tie columns, so that equal keys
can't make results differ between runs.

Grid, centre and jittered sampling are ranks within cells, which are much smaller than nodes: no task ever has to hold a
node. The distance samplers are greedy scans in Morton order; a task reads a node as a sorted stream and holds only the
points that it accepts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from octolith.functions import geometry as G
from octolith.functions import morton as M


@dataclass(frozen=True)
class Context:
    """What all samplers are given: cubic root bounds, spacing at the root, node capacity, tie-breaking columns."""

    bounds: G.Bounds
    spacing: float
    max_points: int = 20_000
    tie: tuple[str, ...] = ()

    def order(self) -> list[Column]:
        return [F.col("morton"), *map(F.col, self.tie)]


def with_keys(points: DataFrame, bounds: G.Bounds) -> DataFrame:
    """Points with their key; positions outside count at the border (M6)."""
    return points.withColumn("morton", M.encode("x", "y", "z", bounds))


class Sampler:
    name = ""

    def supports(self, level: int, ctx: Context) -> bool:
        """Whether keys are deep enough for this level; a level beyond takes all points."""
        return G.candidate_level(ctx.bounds.extent, G.spacing_at(ctx.spacing, level)) < M.LEVELS

    def mark(self, df: DataFrame, level: int, ctx: Context) -> DataFrame:
        raise NotImplementedError


class GridSampler(Sampler):
    """One point of each cell; the same picks as mark() follow in numpy from `cells` and `distances` of rows in key and tie order."""

    def cells(self, morton: np.ndarray, level: int, ctx: Context) -> np.ndarray:
        c = G.candidate_level(ctx.bounds.extent, G.spacing_at(ctx.spacing, level))
        return morton >> 3 * (M.LEVELS - 1 - max(c, level))

    def distances(self, morton: np.ndarray, xyz: np.ndarray, level: int, ctx: Context) -> np.ndarray | None:
        """Squared distances by which a cell's points are ordered before their keys; None for no such order."""
        return None


def _first(df: DataFrame, partition: list[Column], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("selected", F.row_number().over(w) == 1)


def squared(v: list[np.ndarray]) -> np.ndarray:
    return v[0] * v[0] + v[1] * v[1] + v[2] * v[2]


def cell_of(level: int, ctx: Context) -> tuple[int, list[Column]]:
    """(candidate level, columns that tell cells apart); without a candidate level a node is one cell."""
    c = G.candidate_level(ctx.bounds.extent, G.spacing_at(ctx.spacing, level))
    node = M.node_of(F.col("morton"), level + 1)
    return c, [node] if c <= level else [M.truncate(F.col("morton"), c)]


class GridFirst(GridSampler):
    """The first point in Morton order of every occupied cell (A1)."""

    name = "RANDOM_GRID"

    def mark(self, df, level, ctx):
        return _first(df, cell_of(level, ctx)[1], ctx.order())


class GridCentre(GridSampler):
    """The point closest to the centre of every occupied cell (A2)."""

    name = "GRID_CENTER"

    def mark(self, df, level, ctx):
        c, cell = cell_of(level, ctx)
        if c == -1:
            return _first(df, cell, ctx.order())
        size = ctx.bounds.extent / 2.0 ** (c + 1)
        grid = M.to_grid(M.truncate(F.col("morton"), c))
        centre = [F.lit(low) + (g + 0.5) * size for low, g in zip(ctx.bounds.low, grid, strict=True)]
        cells = cell if c > level else [*cell, M.truncate(F.col("morton"), c)]
        return _first(df, cells, [G.squared_distance(("x", "y", "z"), centre), *ctx.order()])

    def distances(self, morton, xyz, level, ctx):
        c = G.candidate_level(ctx.bounds.extent, G.spacing_at(ctx.spacing, level))
        if c == -1:
            return None
        size = ctx.bounds.extent / 2.0 ** (c + 1)
        grid = M.grid_arrays(morton >> 3 * (M.LEVELS - 1 - c))
        return squared([xyz[:, k] - (low + (g + 0.5) * size) for k, (low, g) in enumerate(zip(ctx.bounds.low, grid, strict=True))])


def affine_permutations(n: int, count: int = 16) -> list[list[int]]:
    """Permutations of 1..n (n a power of two) by a rule: odd steps from different starts."""
    return [[((2 * ((5 * k + 3) % max(1, n // 2)) + 1) * i + 7 * k + 1) % n + 1 for i in range(n)] for k in range(count)]


@dataclass(frozen=True)
class Jittered(GridSampler):
    """The point closest to a jittered target in every cell of a power-of-two grid (A5).

    `permutations(n)` gives 16 permutations of 1..n for n of 16, 32 or 64; results for other tables follow by passing them.
    """

    permutations: Callable[[int], Sequence[Sequence[int]]] = affine_permutations
    name = "JITTERED"

    def grid(self, level: int, ctx: Context) -> tuple[int, int]:
        """(cells along an axis, key level of a cell); too few or too deep is an error."""
        extent = ctx.bounds.extent / 2.0 ** (level + 1)
        cells = G.previous_power(int(extent / G.spacing_at(ctx.spacing, level)))
        if cells < 16:
            raise ValueError("grids of fewer than 16 cells an axis aren't supported: the spacing is too large")
        deep = level + int(math.log2(cells))
        if deep >= M.LEVELS:
            raise ValueError(f"level {level} is too deep to be sampled with jittered grids")
        return cells, deep

    def supports(self, level, ctx):
        try:
            self.grid(level, ctx)
        except ValueError as e:
            if "deep" in str(e):
                return False
            raise
        return True

    def mark(self, df, level, ctx):
        cells, deep = self.grid(level, ctx)
        size = ctx.bounds.extent / 2.0 ** (level + 1) / cells
        n, start = min(cells, 64), 3 * (level + 1) % 16
        tables = self.permutations(n)
        cell, node = M.truncate(F.col("morton"), deep), M.node_of(F.col("morton"), level + 1)
        gx, gy, gz = M.to_grid(cell.bitwiseAND(F.lit(cells**3 - 1)))
        target = []
        for k, (low, g, other) in enumerate(zip(G.node_low(node, F.lit(level + 1), ctx.bounds), (gx, gy, gz), (gy + gz, gx + gz, gx + gy), strict=True)):
            table = F.array(*[F.lit(v - 1) for v in tables[(start + k) % 16]])
            target.append(low + (g * size + F.get(table, F.pmod(other, F.lit(n)).cast("int")) * (size / cells)))
        return _first(df, [cell], [G.squared_distance(("x", "y", "z"), target), *ctx.order()])

    def cells(self, morton, level, ctx):
        return morton >> 3 * (M.LEVELS - 1 - self.grid(level, ctx)[1])

    def distances(self, morton, xyz, level, ctx):
        cells, deep = self.grid(level, ctx)
        node_size = ctx.bounds.extent / 2.0 ** (level + 1)
        size, n, start = node_size / cells, min(cells, 64), 3 * (level + 1) % 16
        tables = np.array(self.permutations(n), np.int64) - 1
        gx, gy, gz = M.grid_arrays((morton >> 3 * (M.LEVELS - 1 - deep)) & (cells**3 - 1))
        off = []
        for k, (low, i, g, other) in enumerate(zip(ctx.bounds.low, M.grid_arrays(morton >> 3 * (M.LEVELS - 1 - level)), (gx, gy, gz), (gy + gz, gx + gz, gx + gy), strict=True)):
            jitter = tables[(start + k) % 16][other % n]
            off.append(xyz[:, k] - ((low + i * node_size) + (g * size + jitter * (size / cells))))
        return squared(off)


class SparseGrid:
    """Accepted positions by cells of the spacing's size."""

    def __init__(self, spacing: float):
        self.edge, self.square = spacing, float(np.float32(spacing) * np.float32(spacing))
        self.cells: dict[tuple[int, int, int], list[tuple[float, float, float]]] = {}

    def cell(self, p) -> tuple[int, int, int]:
        return tuple(math.floor(v / self.edge) for v in p)

    def is_distant(self, p) -> bool:
        i, j, k = self.cell(p)
        for a in (i - 1, i, i + 1):
            for b in (j - 1, j, j + 1):
                for c in (k - 1, k, k + 1):
                    for q in self.cells.get((a, b, c), ()):
                        if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 < self.square:
                            return False
        return True

    def add_unchecked(self, p) -> None:
        self.cells.setdefault(self.cell(p), []).append(p)

    def add(self, p) -> bool:
        ok = self.is_distant(p)
        if ok:
            self.add_unchecked(p)
        return ok


class PoissonScan:
    """Greedy scan: accept what is at least the spacing from all accepted; only every step-th point is looked at.

    The same decisions as SparseGrid.add, with cell numbers computed at once: most points fall to one of their own cell.
    Points come in order, in pieces of any size; only accepted ones are held.
    """

    STRIDE = 1 << 21

    def __init__(self, spacing: float, step: int = 1):
        self.spacing, self.step, self.seen, self.origin = spacing, step, 0, None
        self.square = float(np.float32(spacing) * np.float32(spacing))
        self.cells: dict[int, list[tuple[float, float, float]]] = {}
        self.near = sorted((((i * self.STRIDE + j) * self.STRIDE + k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)), key=lambda o: (o != 0, o))

    def take(self, xyz: np.ndarray) -> np.ndarray:
        """Which of the next points are accepted."""
        out, cells, square = np.zeros(len(xyz), bool), self.cells, self.square
        if not len(xyz):
            return out
        # Cells count from the first point's; where far ones share a number, distances tell them apart.
        cell = np.floor(xyz / self.spacing)
        self.origin = cell[0] if self.origin is None else self.origin
        cell = (cell - self.origin).astype(np.int64)
        codes = (cell[:, 0] * self.STRIDE + cell[:, 1]) * self.STRIDE + cell[:, 2]
        first = -self.seen % self.step
        self.seen += len(xyz)
        for n, code, (x, y, z) in zip(range(first, len(xyz), self.step), codes[first :: self.step].tolist(), xyz[first :: self.step].tolist(), strict=True):
            for o in self.near:
                found = cells.get(code + o)
                if found and any((x - a) * (x - a) + (y - b) * (y - b) + (z - c) * (z - c) < square for a, b, c in found):
                    break
            else:
                cells.setdefault(code, []).append((x, y, z))
                out[n] = True
        return out


class NextScan:
    """Accept the first point, then whatever is at least the spacing from the one accepted last."""

    def __init__(self, spacing: float, step: int = 1):
        self.square, self.step, self.seen, self.last = float(np.float32(spacing) * np.float32(spacing)), step, 0, None

    def take(self, xyz: np.ndarray) -> np.ndarray:
        out, first = np.zeros(len(xyz), bool), -self.seen % self.step
        self.seen += len(xyz)
        for i in range(first, len(xyz), self.step):
            if self.last is None or ((xyz[i] - self.last) ** 2).sum() >= self.square:
                self.last, out[i] = xyz[i], True
        return out


def poisson(xyz: np.ndarray, spacing: float, step: int = 1) -> np.ndarray:
    """The picks of a whole node."""
    return PoissonScan(spacing, step).take(xyz)


def z_order_next(xyz: np.ndarray, spacing: float, step: int = 1) -> np.ndarray:
    return NextScan(spacing, step).take(xyz)


def _density_step(level: int) -> int:
    return 4 if level < 0 else 2 if level < 1 else 1


@dataclass(frozen=True)
class Greedy(Sampler):
    """A scan of each node's points in Morton order.

    A decision needs all earlier ones nearby, and Morton order makes such chains as long as a node has cells along its
    axes, so that rounds of joins would be hundreds. Nodes are scanned as streams instead: Spark sorts them (and spills),
    a task reads them batch by batch and holds nothing but accepted points, whose number the spacing bounds.
    """

    name: str = "MIN_DISTANCE"
    scan: Callable = PoissonScan
    step: Callable[[int], int] = field(default=lambda level: 1)
    one_when_coarse: bool = False

    def mark(self, df, level, ctx):
        if self.one_when_coarse and G.candidate_level(ctx.bounds.extent, G.spacing_at(ctx.spacing, level)) == -1:
            return _first(df, [M.node_of(F.col("morton"), level + 1)], ctx.order())
        spacing, step, scan, shift = G.spacing_at(ctx.spacing, level), self.step(level), self.scan, 3 * (M.LEVELS - 1 - level)

        def run(batches):
            now, state = None, None
            for batch in batches:
                xyz = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in "xyz"], axis=1)
                node = batch.column(batch.schema.get_field_index("morton")).to_numpy() >> min(shift, 63)
                edges = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
                picks = []
                for a, b in zip(edges, edges[1:], strict=False):
                    if a < b:
                        if now is None or node[a] != now:
                            now, state = node[a], scan(spacing, step)
                        picks.append(state.take(xyz[a:b]))
                if picks:
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(picks))], names=[*batch.schema.names, "selected"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        ordered = df.repartition(M.node_of(F.col("morton"), level + 1)).sortWithinPartitions(*ctx.order())
        return ordered.mapInArrow(run, f"{fields}, selected boolean")


SAMPLERS: dict[str, Sampler] = {
    "RANDOM_GRID": GridFirst(),
    "GRID_CENTER": GridCentre(),
    "MIN_DISTANCE": Greedy(),
    "MIN_DISTANCE_FAST": Greedy("MIN_DISTANCE_FAST", PoissonScan, _density_step, True),
    "JITTERED": Jittered(),
    "Z_ORDER_NEXT": Greedy("Z_ORDER_NEXT", NextScan),
}


def sampler(name: str) -> Sampler:
    """By name; an unknown one is an error."""
    if name not in SAMPLERS:
        raise ValueError(f"unknown sampling strategy {name!r}; one of {', '.join(SAMPLERS)}")
    return SAMPLERS[name]

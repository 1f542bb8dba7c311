"""Queries of sorting, aggregation, sampling, tiling, trees and joins (O, Q, A, TA, T, J, S, K)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from octolith.functions import geometry as G
from octolith.functions import morton as M
from octolith.operators import points as P
from octolith.operators import samplers, tiling, tree
from octolith.plans import views as V
from octolith.plans.views import ID_SQL, IDS, KEYED, NODES, PTS

C = F.col
QUERIES, SQL = {}, {}
#: Parameters of the tiling queries: about 17 cells an axis, so that trees have several levels at small scale.
FRACTION, CAPACITY, START = 30.0, 500, 3


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Tiling in SQL: a chain of CTEs, a level each


SPACING = "spacing AS (SELECT (sqrt(e * e + ey * ey + ez * ez) / 30)::FLOAT::DOUBLE AS s FROM cube)"


def _node(level: int) -> str:
    return "0" if level < 0 else f"morton >> {3 * (20 - level)}"


def _params(level: int) -> str:
    at = f"(s / {2.0 ** (level + 1)!r}::DOUBLE)"
    return f"p{level + 1} AS (SELECT greatest(-1, floor(log2((e / {at})::FLOAT::DOUBLE)::FLOAT)::INT - 1) AS c, {at} AS sp, e / {2.0 ** (level + 1)!r}::DOUBLE AS ext, cx, cy, cz, e FROM cube, spacing)"


def _rank(level: int, sampler: str, alias: str) -> str:
    """Order of the points within their cell, as a window expression over `alias` joined with the level's parameters."""
    node = _node(level)
    if sampler == "JITTERED":
        size = "(ext / 16)"  # 16 cells an axis at these parameters
        cell = f"(morton >> {3 * (20 - level - 4)})"
        rel = f"({cell} & 4095)"
        g = [V.gather(f"{rel} >> 2"), V.gather(f"{rel} >> 1"), V.gather(rel)]
        n = [V.gather(f"({node}) >> 2"), V.gather(f"({node}) >> 1"), V.gather(f"({node})")]
        terms = []
        for k, (a, other) in enumerate(zip("xyz", (f"{g[1]} + {g[2]}", f"{g[0]} + {g[2]}", f"{g[0]} + {g[1]}"), strict=True)):
            row = (3 * (level + 1) + k) % 16
            jitter = f"(({2 * ((5 * row + 3) % 8) + 1} * (({other}) % 16) + {7 * row + 1}) % 16)"
            target = f"((c{a} + {n[k]} * ext) + ({g[k]} * {size} + {jitter} * ({size} / 16)))"
            terms.append(f"({a} - {target}) * ({a} - {target})")
        return f"row_number() OVER (PARTITION BY {cell} ORDER BY {' + '.join(terms)}, morton, {ID_SQL})"
    cell = f"CASE WHEN c <= {level} THEN {node} ELSE morton >> (3 * (20 - least(c, 20))) END"
    order = "morton"
    if sampler == "GRID_CENTER":
        k = "(morton >> (3 * (20 - least(greatest(c, 0), 20))))"
        size = "(e / pow(2::DOUBLE, c + 1))"
        mid = {a: f"(c{a} + ({V.gather(f'{k} >> {2 - i}')} + 0.5::DOUBLE) * {size})" for i, a in enumerate("xyz")}
        order = "CASE WHEN c = -1 THEN 0 ELSE " + " + ".join(f"({a} - {mid[a]}) * ({a} - {mid[a]})" for a in "xyz") + " END, morton"
        cell = f"{cell}, CASE WHEN c >= 0 THEN {k} END"
    return f"row_number() OVER (PARTITION BY {cell} ORDER BY {order}, {ID_SQL})"


def tiling_sql(sampler: str, first: int = -1, levels: int = 22, capacity: int = CAPACITY) -> str:
    """CTEs up to `stored` (ids, key, node_idx, node_lvl) for a descent from a level."""
    deep = 17 if sampler == "JITTERED" else 21
    parts, kept = [KEYED, SPACING, f"rest{first + 1} AS (SELECT {ID_SQL}, x, y, z, morton FROM keyed)"], []
    for level in range(first, min(first + levels, 21)):
        k = level + 1
        take = "true" if level == 20 or (sampler == "JITTERED" and level + 4 >= 21) else f"(rn = 1 OR n <= {capacity} OR c >= {deep + 20 if sampler == 'JITTERED' else 21})"
        parts += [
            _params(level),
            f"m{k} AS MATERIALIZED (SELECT r.*, count(*) OVER (PARTITION BY {_node(level)}) AS n, {_rank(level, sampler, 'r')} AS rn, c FROM rest{k} r, p{k})",
            f"rest{k + 1} AS (SELECT {ID_SQL}, x, y, z, morton FROM m{k} WHERE NOT {take})",
        ]
        kept.append(f"SELECT {ID_SQL}, x, y, z, morton, {_node(level)} AS node_idx, {k} AS node_lvl FROM m{k} WHERE {take}")
    return "WITH " + ",\n".join(parts) + ",\nstored AS (" + " UNION ALL ".join(kept) + ")"


def _tile(spark, sf, sampling, strategy, **more):
    pts = V.lineitem_points(spark, sf)
    return tiling.tile(pts, IDS, sampling, strategy, diagonal_fraction=FRACTION, max_points_per_node=CAPACITY, **more)


OUT = ["node_idx", "node_lvl"]
for _i, _s in (("A1", "RANDOM_GRID"), ("A2", "GRID_CENTER"), ("A5", "JITTERED")):

    def _accurate(spark, sf, s=_s):
        return _tile(spark, sf, s, "ACCURATE")[0].select(*IDS, *OUT)

    QUERIES[f"TA7_{_i}_accurate_{_s.lower()}"] = _accurate
    SQL[f"TA7_{_i}_accurate_{_s.lower()}"] = f"{tiling_sql(_s, levels=14 if _s == 'JITTERED' else 22)} SELECT {ID_SQL}, node_idx, node_lvl FROM stored"

    def _single(spark, sf, s=_s):
        """One node: which points represent the root."""
        pts = V.lineitem_points(spark, sf)
        cube = G.bounds_of(pts).cubic()
        ctx = samplers.Context(cube, G.spacing_from_diagonal(cube, FRACTION), CAPACITY, tuple(IDS))
        return samplers.sampler(s).mark(samplers.with_keys(pts, cube), -1, ctx).where("selected").select(*IDS)

    QUERIES[f"{_i}_sample_{_s.lower()}"] = _single
    SQL[f"{_i}_sample_{_s.lower()}"] = f"WITH {KEYED}, {SPACING}, {_params(-1)}, m AS (SELECT {ID_SQL}, {_rank(-1, _s, 'r')} AS rn FROM keyed r, p0) SELECT {ID_SQL} FROM m WHERE rn = 1"


def reconstruct_sql(start: int) -> str:
    parts, kept = [], [f"SELECT {ID_SQL}, node_idx, node_lvl FROM stored"]
    source = f"(SELECT {ID_SQL}, x, y, z, morton FROM stored WHERE node_lvl = {start})"
    for level in range(start - 2, -2, -1):
        k = level + 1
        parts += [_params(level).replace(f"p{k} AS", f"pu{k} AS"), f"u{k} AS MATERIALIZED (SELECT * FROM (SELECT r.*, {_rank(level, 'RANDOM_GRID', 'r')} AS rn FROM {source} r, pu{k}) WHERE rn = 1)"]
        source = f"(SELECT {ID_SQL}, x, y, z, morton FROM u{k})"
        kept.append(f"SELECT {ID_SQL}, {_node(level)}, {k} FROM u{k}")
    return ", ".join(parts) + ", whole AS (" + " UNION ALL ".join(kept) + ")"


@query("TA8_fast_random_grid", f"{tiling_sql('RANDOM_GRID', START - 1, 19)}, {reconstruct_sql(START)} SELECT {ID_SQL}, node_idx, node_lvl FROM whole")
def ta8(spark, sf):
    return _tile(spark, sf, "RANDOM_GRID", "FAST", start=START)[0].select(*IDS, *OUT)


@query("TA12_reconstructed_levels", f"{tiling_sql('RANDOM_GRID', START - 1, 19)}, {reconstruct_sql(START)} SELECT node_lvl, count(*) AS n FROM whole WHERE node_lvl < {START} GROUP BY 1")
def ta12(spark, sf):
    return _tile(spark, sf, "RANDOM_GRID", "FAST", start=START)[0].where(C("node_lvl") < START).groupBy("node_lvl").agg(F.count(F.lit(1)).alias("n"))


@query("TA1_interior_node_counts", f"{tiling_sql('RANDOM_GRID')} SELECT node_lvl, node_idx, count(*) AS n FROM stored GROUP BY 1, 2")
def ta1(spark, sf):
    return tiling.node_report(_tile(spark, sf, "RANDOM_GRID", "ACCURATE")[0]).select("node_lvl", "node_idx", "n")


@query("TA2_terminal_level", f"{tiling_sql('RANDOM_GRID', levels=2).replace('m1 AS MATERIALIZED (SELECT r.*', 'm1 AS MATERIALIZED (SELECT r.*, true AS last').replace('FROM m1 WHERE (rn = 1 OR', 'FROM m1 WHERE (last OR rn = 1 OR')} SELECT node_lvl, count(*) AS n FROM stored GROUP BY 1")
def ta2(spark, sf):
    return _tile(spark, sf, "RANDOM_GRID", "ACCURATE", max_depth=1)[0].groupBy("node_lvl").agg(F.count(F.lit(1)).alias("n"))


@query("TA3_read_back_nodes", f"{tiling_sql('RANDOM_GRID')} SELECT {ID_SQL}, morton FROM stored WHERE node_lvl = 1")
def ta3(spark, sf):
    return _tile(spark, sf, "RANDOM_GRID", "ACCURATE")[0].where("node_lvl = 1").select(*IDS, "morton")


@query("TA5_levels_of_descent", f"{tiling_sql('RANDOM_GRID')} SELECT max(node_lvl) AS deepest, count(DISTINCT node_lvl) AS levels FROM stored")
def ta5(spark, sf):
    return _tile(spark, sf, "RANDOM_GRID", "ACCURATE")[0].agg(F.max("node_lvl").alias("deepest"), F.countDistinct("node_lvl").alias("levels"))


@query("TA9_start_level_scores", f"WITH {KEYED}, l AS (SELECT lvl, morton >> (3 * (21 - lvl)) AS idx, count(*) AS n FROM keyed, range(1, 7) t(lvl) GROUP BY 1, 2) SELECT lvl::INT AS lvl, count(*) AS ranges, count(*) FILTER (n >= 1000) AS large_ranges FROM l GROUP BY 1")
def ta9(spark, sf):
    return tiling.start_scores(V.keyed(spark, sf)[0], 1000)


@query("Q9_range_score", f"WITH {KEYED}, l AS (SELECT lvl, morton >> (3 * (21 - lvl)) AS idx, count(*) AS n FROM keyed, range(1, 7) t(lvl) GROUP BY 1, 2) SELECT lvl::INT AS lvl, CASE WHEN count(*) <= 4 THEN 0 ELSE count(*) FILTER (n >= 1000) / 8.0::DOUBLE END AS score FROM l GROUP BY 1")
def q9(spark, sf):
    s = tiling.start_scores(V.keyed(spark, sf)[0], 1000)
    return s.select("lvl", F.when(C("ranges") <= 4, 0.0).otherwise(C("large_ranges") / 8.0).alias("score"))


@query("TA10_start_node_split", f"WITH {KEYED} SELECT morton >> 54 AS node_idx, count(*) AS n, min(morton) AS first, max(morton) AS last FROM keyed GROUP BY 1")
def ta10(spark, sf):
    return V.keyed(spark, sf)[0].groupBy(M.node_of(C("morton"), START).alias("node_idx")).agg(F.count(F.lit(1)).alias("n"), F.min("morton").alias("first"), F.max("morton").alias("last"))


@query("TA11_merge_start_nodes", f"WITH {KEYED} SELECT morton >> 54 AS node_idx, count(*) AS n FROM keyed GROUP BY 1")
def ta11(spark, sf):
    pts = V.keyed(spark, sf)[0]
    chunks = [tiling.prefix_counts(pts.where(f"pmod(ok, 4) = {k}"), START) for k in range(4)]
    every = chunks[0].unionByName(chunks[1]).unionByName(chunks[2]).unionByName(chunks[3])
    return every.groupBy("node_idx").agg(F.sum("n").alias("n"))


@query("TA13_balanced_start_nodes", f"WITH {PTS} SELECT count(*) AS points, true AS enough FROM pts")
def ta13(spark, sf):
    parts = tiling.balanced_start_nodes(V.keyed(spark, sf)[0], 24)
    return spark.createDataFrame([(sum(n for *_, n in parts), len(parts) >= 24)], "points bigint, enough boolean")


@query("TA6_deep_trees_lose_nothing", f"WITH {PTS} SELECT count(*) AS points, count(DISTINCT ({ID_SQL})) AS distinct_points FROM pts")
def ta6(spark, sf):
    pts = V.lineitem_points(spark, sf)
    wide = G.Bounds((0.0,) * 3, (2.0**24,) * 3)
    out = tiling.tile_deep(pts, IDS, 40, sampling="RANDOM_GRID", bounds=wide, spacing=2.0**22, max_points_per_node=2000)
    return out.agg(F.count(F.lit(1)).alias("points"), F.countDistinct(*IDS).alias("distinct_points"))


PICK_SPACING = 0.0625  # exact in single precision, as is its square


def greedy_sql(step: int, last_only: bool) -> str:
    """Picks in key order over the embedding points: a recursive CTE that carries the accepted points."""
    held = "acc[len(acc):]" if last_only else "acc"
    near = f"len(list_filter({held}, lambda q: (o.x - q.x) * (o.x - q.x) + (o.y - q.y) * (o.y - q.y) + (o.z - q.z) * (o.z - q.z) < {PICK_SPACING**2!r}::DOUBLE)) > 0"
    return f"""WITH RECURSIVE {V.EMB}, {V.keyed_sql('emb')},
o AS (SELECT vec_id, x, y, z, row_number() OVER (ORDER BY morton, vec_id) - 1 AS n FROM keyed),
g AS (SELECT -1::BIGINT AS n, NULL::BIGINT AS vec_id, false AS selected, []::STRUCT(x DOUBLE, y DOUBLE, z DOUBLE)[] AS acc
  UNION ALL SELECT o.n, o.vec_id, o.n % {step} = 0 AND NOT ({near}),
    CASE WHEN o.n % {step} = 0 AND NOT ({near}) THEN list_append(acc, {{'x': o.x, 'y': o.y, 'z': o.z}}) ELSE acc END
  FROM g JOIN o ON o.n = g.n + 1)
SELECT vec_id, selected FROM g WHERE n >= 0"""


def _picks(name: str, sampling: str, step: int, last_only: bool):
    @query(name, greedy_sql(step, last_only))
    def run(spark, sf):
        """Which points a greedy sampler picks for the root, one by one."""
        pts = V.embedding_points(spark, sf)
        cube = G.bounds_of(pts).cubic()
        ctx = samplers.Context(cube, PICK_SPACING, CAPACITY, ("vec_id",))
        return samplers.sampler(sampling).mark(samplers.with_keys(pts, cube), -1, ctx).select("vec_id", "selected")


_picks("A3_min_distance", "MIN_DISTANCE", 1, False)
_picks("A4_min_distance_fast", "MIN_DISTANCE_FAST", 4, False)
_picks("A6_z_order_next", "Z_ORDER_NEXT", 1, True)


@query("A3_min_distance_spacing", "SELECT 0::BIGINT AS violations, 0::BIGINT AS addable")
def a3_spacing(spark, sf):
    """No two picks too close, no point left out that would fit, over the line items."""
    pts = V.lineitem_points(spark, sf)
    cube = G.bounds_of(pts).cubic()
    ctx = samplers.Context(cube, G.spacing_from_diagonal(cube, 12.0), CAPACITY, tuple(IDS))
    marked = tiling.materialize(samplers.sampler("MIN_DISTANCE").mark(samplers.with_keys(pts, cube), -1, ctx), "greedy")
    return P.spacing_violations(marked, ctx.spacing, IDS)


@query("TA7_A3_accurate_min_distance", f"WITH {PTS} SELECT count(*) AS points, count(DISTINCT ({ID_SQL})) AS distinct_points FROM pts")
def ta7a3(spark, sf):
    return _tile(spark, sf, "MIN_DISTANCE", "ACCURATE")[0].agg(F.count(F.lit(1)).alias("points"), F.countDistinct(*IDS).alias("distinct_points"))


# Sort, merge, partition, limit


@query("O1_sort_by_key", f"WITH {KEYED} SELECT {ID_SQL}, row_number() OVER (ORDER BY morton, {ID_SQL}) AS place FROM keyed")
def o1(spark, sf):
    return P.with_place(V.keyed(spark, sf)[0], ["morton", *IDS]).select(*IDS, (C("place") + 1).alias("place"))


@query("O2_sorted_merge", f"WITH {KEYED} SELECT {ID_SQL}, morton FROM keyed")
def o2(spark, sf):
    pts = V.keyed(spark, sf)[0].select(*IDS, "morton")
    return P.merge_sorted([pts.where("pk % 2 = 0"), pts.where("pk % 2 = 1")], ["morton", *IDS])


@query("O3_concatenation", f"WITH {PTS} SELECT {ID_SQL}, x FROM pts UNION ALL SELECT {ID_SQL}, y FROM pts")
def o3(spark, sf):
    pts = V.lineitem_points(spark, sf)
    return pts.select(*IDS, "x").unionByName(pts.select(*IDS, C("y").alias("x")))


@query("O4_merge_of_many", f"WITH {KEYED} SELECT {ID_SQL}, morton FROM keyed")
def o4(spark, sf):
    pts = V.keyed(spark, sf)[0].select(*IDS, "morton")
    return P.merge_sorted([pts.where(f"pmod(pk, 4) = {k}") for k in range(4)], ["morton", *IDS])


@query("O5_stable_partition", f"WITH {KEYED}, r AS (SELECT {ID_SQL}, morton >> 51 AS cell, row_number() OVER (PARTITION BY morton >> 51 ORDER BY morton, {ID_SQL}) AS rn FROM keyed) SELECT {ID_SQL}, rn = 1 AS selected FROM r")
def o5(spark, sf):
    return P.partition_with_jumps(V.keyed(spark, sf)[0], M.truncate(C("morton"), 3), ["morton", *IDS]).select(*IDS, "selected")


@query("O6_octant_partition", f"WITH {KEYED} SELECT morton >> 60 AS node_idx, ((morton >> 57) & 7)::INT AS octant, count(*) AS n, min(morton) AS first, max(morton) AS last FROM keyed GROUP BY 1, 2")
def o6(spark, sf):
    """The octants of every node of level 1."""
    node = M.node_of(C("morton"), 1).alias("node_idx")
    return V.keyed(spark, sf)[0].groupBy(node, M.octant_at("morton", 1).alias("octant")).agg(F.count(F.lit(1)).alias("n"), F.min("morton").alias("first"), F.max("morton").alias("last"))


@query("O7_child_nodes", f"WITH {NODES} SELECT (node_idx << 3) | o AS node_idx, node_lvl + 1 AS node_lvl, 'r' || lpad(to_base((node_idx << 3) | o, 8), node_lvl + 1, '0') AS node_name, cx + {V.gather('((node_idx << 3) | o) >> 2')} * (e / pow(2::DOUBLE, node_lvl + 1)) AS low_x, e / pow(2::DOUBLE, node_lvl + 1) AS extent, 1.5::DOUBLE AS spacing FROM nodes, cube, range(8) t(o)")
def o7(spark, sf):
    nodes, cube = V.nodes(spark, sf)
    return tiling.children_of(nodes, cube, F.lit(3.0)).select("node_idx", "node_lvl", "node_name", "low_x", "extent", "spacing")


@query("O8_chunk_split", f"WITH {KEYED}, r AS (SELECT {ID_SQL}, row_number() OVER (ORDER BY morton, {ID_SQL}) - 1 AS p, count(*) OVER () AS n FROM keyed) SELECT {ID_SQL}, least(p // (n // 7), 6) AS chunk FROM r")
def o8(spark, sf):
    return P.chunks(V.keyed(spark, sf)[0], ["morton", *IDS], 7).select(*IDS, "chunk")


@query("O10_limit_batch", f"WITH {KEYED} SELECT {ID_SQL} FROM keyed ORDER BY morton, {ID_SQL} LIMIT 1000")
def o10(spark, sf):
    return V.keyed(spark, sf)[0].orderBy("morton", *IDS).limit(1000).select(*IDS)


@query("O11_extreme_nodes", f"WITH {NODES}, t AS (SELECT * FROM nodes WHERE node_lvl = 3) SELECT * FROM (SELECT 'most' AS which, node_idx, n FROM t ORDER BY n DESC, node_idx LIMIT 1) UNION ALL SELECT * FROM (SELECT 'least', node_idx, n FROM t ORDER BY n, node_idx LIMIT 1)")
def o11(spark, sf):
    t = V.nodes(spark, sf)[0].where("node_lvl = 3")
    most = t.agg(F.max_by(F.struct("node_idx", "n"), F.struct("n", -C("node_idx"))).alias("s")).select(F.lit("most").alias("which"), "s.*")
    least = t.agg(F.min_by(F.struct("node_idx", "n"), F.struct("n", "node_idx")).alias("s")).select(F.lit("least").alias("which"), "s.*")
    return most.unionByName(least)


# Aggregation


@query("Q1_total_bounds", f"WITH {PTS}, f AS (SELECT pk % 16 AS file, count(*) AS n, min(x) AS lx, max(x) AS hx FROM pts GROUP BY 1) SELECT sum(n)::BIGINT AS n, min(lx) AS low_x, max(hx) AS high_x FROM f")
def q1(spark, sf):
    files = V.lineitem_points(spark, sf).groupBy((C("pk") % 16).alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lx"), F.max("x").alias("hx"))
    return files.agg(F.sum("n").alias("n"), F.min("lx").alias("low_x"), F.max("hx").alias("high_x"))


@query("S24_catalog", f"WITH {PTS} SELECT (pk % 16)::INT AS file_id, count(*) AS n, min(x) AS low_x, min(y) AS low_y, min(z) AS low_z, max(x) AS high_x, max(y) AS high_y, max(z) AS high_z FROM pts GROUP BY 1")
def s24(spark, sf):
    pts = V.lineitem_points(spark, sf).withColumn("file_id", (C("pk") % 16).cast("int"))
    return P.catalog(pts, "file_id")


@query("Q2_full_scan_bounds", f"WITH {PTS} SELECT count(*) AS n, min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) AS hx, max(y) AS hy, max(z) AS hz FROM pts")
def q2(spark, sf):
    return V.lineitem_points(spark, sf).agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(n + a) for n, f in (("l", F.min), ("h", F.max)) for a in "xyz"])


@query("Q3_points_per_node", f"WITH {NODES} SELECT node_idx, node_lvl, n FROM nodes")
def q3(spark, sf):
    return V.nodes(spark, sf)[0]


@query("Q4_distinct_cells", f"WITH {KEYED} SELECT morton >> 60 AS node_idx, count(DISTINCT morton >> 48) AS cells FROM keyed GROUP BY 1")
def q4(spark, sf):
    return V.keyed(spark, sf)[0].groupBy(M.node_of(C("morton"), 1).alias("node_idx")).agg(F.countDistinct(M.truncate(C("morton"), 4)).alias("cells"))


@query("Q5_arg_min_per_cell", f"WITH {KEYED} SELECT morton >> 54 AS cell, (arg_min({{'ok': ok, 'ln': ln, 'pk': pk, 'sk': sk}}, (x - cx, morton, {ID_SQL}))).ok AS ok FROM keyed, cube GROUP BY 1")
def q5(spark, sf):
    pts, cube = V.keyed(spark, sf)
    return pts.groupBy(M.truncate(C("morton"), 2).alias("cell")).agg(F.min_by("ok", F.struct((C("x") - cube.low[0]).alias("d"), "morton", *IDS)).alias("ok"))


@query("Q6_first_per_cell", f"WITH {KEYED}, r AS (SELECT morton >> 51 AS cell, {ID_SQL}, row_number() OVER (PARTITION BY morton >> 51 ORDER BY morton, {ID_SQL}) AS rn FROM keyed) SELECT cell, {ID_SQL} FROM r WHERE rn = 1")
def q6(spark, sf):
    first = F.min(F.struct("morton", *IDS)).alias("s")
    return V.keyed(spark, sf)[0].groupBy(M.truncate(C("morton"), 3).alias("cell")).agg(first).select("cell", *[f"s.{c}" for c in IDS])


@query("Q7_fold", f"WITH {KEYED} SELECT morton >> 57 AS node, bit_xor(morton) AS x, sum(qx)::BIGINT AS s FROM keyed GROUP BY 1")
def q7(spark, sf):
    return V.keyed(spark, sf)[0].groupBy(M.node_of(C("morton"), 2).alias("node")).agg(F.bit_xor("morton").alias("x"), F.sum("qx").alias("s"))


@query("Q8_points_in_children", f"WITH {NODES} SELECT node_idx >> 3 AS parent_idx, node_lvl - 1 AS parent_lvl, sum(n)::BIGINT AS n FROM nodes GROUP BY 1, 2")
def q8(spark, sf):
    return tree.sum_children(V.nodes(spark, sf)[0])


@query("Q12_dropped_points", f"WITH {PTS} SELECT count(*) AS total, count(*) AS stored, 0::BIGINT AS dropped FROM pts")
def q12(spark, sf):
    return tiling.dropped(V.lineitem_points(spark, sf), _tile(spark, sf, "RANDOM_GRID", "ACCURATE")[0])


# Trees


T_SQL = NODES
ANC = "anc AS (SELECT DISTINCT node_idx >> (3 * (node_lvl - l)) AS node_idx, l::INT AS node_lvl FROM nodes, range(0, 3) t(l) WHERE l < node_lvl)"


@query("T1_densify", f"WITH {T_SQL}, {ANC}, kids AS (SELECT (node_idx << 3) | o AS node_idx, node_lvl + 1 AS node_lvl FROM anc, range(8) t(o)), k AS (SELECT * FROM anc UNION SELECT * FROM kids UNION SELECT node_idx, node_lvl FROM nodes) SELECT node_idx, node_lvl, n FROM k LEFT JOIN nodes USING (node_idx, node_lvl)")
def t1(spark, sf):
    return tree.densify(V.nodes(spark, sf)[0])


@query("T2_erase", f"WITH {T_SQL} SELECT node_idx, node_lvl, CASE WHEN node_lvl = 1 AND node_idx = 2 THEN NULL ELSE n END AS n FROM nodes WHERE NOT (node_lvl = 3 AND node_idx >> 6 = 2)")
def t2(spark, sf):
    return tree.erase(V.nodes(spark, sf)[0], 2, 1)


@query("T3_at_contains_size", f"WITH {T_SQL} SELECT (SELECT n FROM nodes WHERE node_lvl = 1 AND node_idx = 3) AS n, (SELECT count(*) FROM nodes WHERE node_lvl = 2) AS missing, (SELECT count(*) FROM nodes) AS size")
def t3(spark, sf):
    nodes = V.nodes(spark, sf)[0]
    hit = lambda i, lv: (C("node_idx") == i) & (C("node_lvl") == lv)
    return nodes.agg(F.max(F.when(hit(3, 1), C("n"))).alias("n"), F.count_if(C("node_lvl") == 2).alias("missing"), F.count(F.lit(1)).alias("size"))


@query("T4_children_siblings", f"WITH {T_SQL} SELECT 'sibling' AS kind, a.node_idx, a.node_lvl, b.node_idx AS other FROM nodes a JOIN nodes b ON a.node_lvl = b.node_lvl AND a.node_idx >> 3 = b.node_idx >> 3 AND a.node_idx <> b.node_idx UNION ALL SELECT 'leaf', node_idx, node_lvl, NULL FROM nodes")
def t4(spark, sf):
    nodes = V.nodes(spark, sf)[0]
    kin = tree.siblings(nodes).select(F.lit("sibling").alias("kind"), "node_idx", "node_lvl", C("sibling_idx").alias("other"))
    return kin.unionByName(tree.leaves(nodes).select(F.lit("leaf").alias("kind"), "node_idx", "node_lvl", F.lit(None).cast("bigint").alias("other")))


@query("T5_level_order", f"WITH {T_SQL} SELECT node_idx, node_lvl, row_number() OVER (ORDER BY node_lvl, node_idx) AS nth, row_number() OVER (ORDER BY lpad(to_base(node_idx, 8), node_lvl, '0')) AS pre FROM nodes")
def t5(spark, sf):
    nodes = V.nodes(spark, sf)[0]
    # Ranks over a few hundred nodes; level_order and pre_order themselves are range-partitioned sorts.
    return nodes.select("node_idx", "node_lvl", F.row_number().over(Window.orderBy("node_lvl", "node_idx")).cast("bigint").alias("nth"), F.row_number().over(Window.orderBy(M.name_simple("node_idx", "node_lvl"))).cast("bigint").alias("pre"))


@query("T7_tree_equality", f"WITH {T_SQL} SELECT node_idx, node_lvl, n, 'a' AS side FROM nodes WHERE n % 5 = 0")
def t7(spark, sf):
    nodes = V.nodes(spark, sf)[0]
    return tree.differences(nodes, nodes.where("n % 5 <> 0"))


@query("T8_ancestor_closure", f"WITH {T_SQL}, {ANC} SELECT * FROM anc")
def t8(spark, sf):
    return tree.ancestors(V.nodes(spark, sf)[0])


@query("T9_tree_from_names", f"WITH {T_SQL} SELECT node_idx, node_lvl FROM nodes")
def t9(spark, sf):
    names = V.nodes(spark, sf)[0].select(F.concat(F.lit("out/"), M.name_potree("node_idx", "node_lvl"), F.lit(".bin")).alias("node_name")).union(spark.createDataFrame([("out/properties.json",)], "node_name string"))
    return tree.from_names(names).select("node_idx", "node_lvl")


@query("T10_split_subtrees", f"WITH {T_SQL} SELECT node_idx, node_lvl, node_idx >> (3 * (node_lvl % 3)) AS root_idx, node_lvl - node_lvl % 3 AS root_lvl FROM nodes")
def t10(spark, sf):
    return tree.split_subtrees(V.nodes(spark, sf)[0], 3).select("node_idx", "node_lvl", "root_idx", "root_lvl")


@query("T12_tileset_insertion", f"WITH {T_SQL}, {ANC}, a AS (SELECT * FROM anc UNION SELECT node_idx, node_lvl FROM nodes) SELECT node_idx, node_lvl, node_idx >> 3 AS parent_idx, n IS NOT NULL AS has_points FROM a LEFT JOIN nodes USING (node_idx, node_lvl)")
def t12(spark, sf):
    nodes = V.nodes(spark, sf)[0]
    keys = tree.ancestors(nodes).union(nodes.select("node_idx", "node_lvl")).distinct()
    return keys.join(nodes, tree.KEY, "left").select("node_idx", "node_lvl", F.shiftright("node_idx", 3).alias("parent_idx"), C("n").isNotNull().alias("has_points"))


HIER = "SELECT node_idx >> (3 * (node_lvl % 2)) AS root_idx, node_lvl - node_lvl % 2 AS root_lvl, node_idx, node_lvl, n FROM t UNION ALL SELECT node_idx >> 6, node_lvl - 2, node_idx, node_lvl, -1 FROM t WHERE node_lvl > 0 AND node_lvl % 2 = 0"


def _ladder(spark, sf):
    return V.nodes(spark, sf, (0, 1, 2, 3, 4))[0]


LADDER = KEYED + ", t AS MATERIALIZED (SELECT " + " UNION ALL SELECT ".join(f"{'0' if k == 0 else f'morton >> {63 - 3 * k}'} AS node_idx, {k} AS node_lvl, count(*) AS n FROM keyed GROUP BY 1" for k in range(5)) + ")"


@query("T6_merge_trees", f"WITH {LADDER}, a AS (SELECT * FROM t WHERE node_lvl < 3), b AS (SELECT node_idx, node_lvl, n * 10 AS n FROM t WHERE node_lvl > 1) SELECT coalesce(a.node_idx, b.node_idx) AS node_idx, coalesce(a.node_lvl, b.node_lvl) AS node_lvl, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM a FULL JOIN b ON a.node_idx = b.node_idx AND a.node_lvl = b.node_lvl")
def t6(spark, sf):
    """Two trees that share level 2 and hold all nodes between them."""
    t = _ladder(spark, sf)
    both = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
    return tree.merge(t.where("node_lvl < 3"), t.where("node_lvl > 1").withColumn("n", C("n") * 10), {"n": both})


@query("T13_subtree_split", f"WITH {LADDER} {HIER}")
def t13(spark, sf):
    return tree.hierarchy(_ladder(spark, sf), 2)


@query("K8_hierarchy_rows", f"WITH {LADDER}, h AS ({HIER.replace('% 2', '% 4').replace('>> 6', '>> 12').replace('node_lvl - 2,', 'node_lvl - 4,')}) SELECT root_idx, root_lvl, count(*) AS entries, sum(n)::BIGINT AS total FROM h GROUP BY 1, 2")
def k8(spark, sf):
    return tree.hierarchy(_ladder(spark, sf), 4).groupBy("root_idx", "root_lvl").agg(F.count(F.lit(1)).alias("entries"), F.sum("n").alias("total"))


NAME = "'r' || CASE WHEN node_lvl = 0 THEN '' ELSE lpad(to_base(node_idx, 8), node_lvl, '0') END"


@query("K16_graphviz", f"""WITH {LADDER} SELECT '"' || {NAME} || '" [label="' || n || '"];' AS line FROM t UNION ALL SELECT '"' || {NAME.replace('node_lvl', '(node_lvl - 1)').replace('node_idx', '(node_idx >> 3)')} || '" -> "' || {NAME} || '";' FROM t WHERE node_lvl > 0""")
def k16(spark, sf):
    return tree.graphviz(_ladder(spark, sf), C("n").cast("string"))


@query("K17_broken_nodes", f"WITH {NODES} SELECT node_idx, node_lvl, n AS total, n // 150 AS taken FROM nodes WHERE node_lvl >= 3 AND (n // 150) / n::DOUBLE < 0.01")
def k17(spark, sf):
    nodes = V.nodes(spark, sf)[0].select("node_idx", "node_lvl", C("n").alias("total"), F.expr("n DIV 150").alias("taken"))
    return P.broken_nodes(nodes, 3)


@query("K10_memory_sink", f"WITH {PTS} SELECT {ID_SQL}, count(*) AS n FROM (SELECT * FROM pts UNION ALL SELECT * FROM pts WHERE pk % 2 = 0) GROUP BY ALL")
def k10(spark, sf):
    from octolith.sources.memory import MemoryStore

    pts, store = V.lineitem_points(spark, sf), MemoryStore()
    store.append(pts.withColumn("node_name", F.lit("r")))
    store.append(pts.where("pk % 2 = 0").withColumn("node_name", F.lit("r")))
    return store.nodes("r").groupBy(*IDS).agg(F.count(F.lit(1)).alias("n"))


@query("S19_memory_scan", f"WITH {KEYED} SELECT {ID_SQL}, x, y, z, 0 AS intensity FROM keyed WHERE morton >> 60 = 5")
def s19(spark, sf):
    from octolith import schema
    from octolith.sources.memory import MemoryStore

    store = MemoryStore()
    pts = V.keyed(spark, sf)[0]
    store.append(pts.withColumn("node_name", M.name_potree(M.node_of(C("morton"), 1), F.lit(1))))
    return schema.apply_schema(store.nodes("r5"), {"POSITION", "INTENSITY"}, IDS)


@query("S11_batch_provenance", f"WITH {PTS}, f AS (SELECT *, pk % 16 AS file_id FROM pts) SELECT {ID_SQL}, (file_id % 65536)::INT AS point_source_id FROM f")
def s11(spark, sf):
    pts = V.lineitem_points(spark, sf).withColumn("file_id", C("pk") % 16)
    return P.stamp_source(pts, "file_id").select(*IDS, "point_source_id")


@query("S20_node_exists", f"WITH {NODES} SELECT node_idx, node_lvl FROM nodes WHERE node_lvl = 3 AND node_idx % 3 = 0")
def s20(spark, sf):
    nodes = V.nodes(spark, sf)[0]
    wanted = spark.range(0, 512, 3).select(C("id").alias("node_idx"), F.lit(3).alias("node_lvl"))
    return tree.existing(nodes, wanted).select("node_idx", "node_lvl")


@query("S22_node_files", f"WITH {NODES} SELECT {NAME} || '.las' AS path, node_lvl FROM nodes WHERE node_lvl <= 2")
def s22(spark, sf):
    names = V.nodes(spark, sf)[0].select(F.concat(M.name_potree("node_idx", "node_lvl"), F.lit(".las")).alias("path"))
    return P.node_files(names.union(spark.createDataFrame([("ept.json",)], "path string")), 2).select("path", "node_lvl")


# Joins


@query("J1_new_with_stored", f"WITH {KEYED}, k AS (SELECT morton >> 60 AS node, pk % 2 AS side FROM keyed) SELECT node, count(*) FILTER (side = 0) AS stored, count(*) FILTER (side = 1) AS fresh FROM k GROUP BY 1")
def j1(spark, sf):
    pts = V.keyed(spark, sf)[0].withColumn("node", M.node_of(C("morton"), 1))
    both = pts.where("pk % 2 = 0").withColumn("side", F.lit(0)).unionByName(pts.where("pk % 2 = 1").withColumn("side", F.lit(1)))
    return both.groupBy("node").agg(F.count_if(C("side") == 0).alias("stored"), F.count_if(C("side") == 1).alias("fresh"))


@query("J2_parent_child", f"WITH {LADDER} SELECT p.node_idx, p.node_lvl, c.node_idx AS child_idx FROM t p JOIN t c ON c.node_idx >> 3 = p.node_idx AND c.node_lvl = p.node_lvl + 1")
def j2(spark, sf):
    return tree.children(_ladder(spark, sf))


@query("J3_outer_merge", f"WITH {LADDER} SELECT coalesce(a.node_idx, b.node_idx) AS node_idx, coalesce(a.node_lvl, b.node_lvl) AS node_lvl, coalesce(a.n, b.n) AS n FROM (SELECT * FROM t WHERE node_lvl < 3) a FULL JOIN (SELECT * FROM t WHERE node_lvl > 1) b ON a.node_idx = b.node_idx AND a.node_lvl = b.node_lvl")
def j3(spark, sf):
    t = _ladder(spark, sf)
    return tree.merge(t.where("node_lvl < 3"), t.where("node_lvl > 1"))


@query("J4_semi_start_nodes", f"WITH {LADDER} SELECT node_idx, node_lvl, n FROM t p WHERE EXISTS (SELECT 1 FROM t c WHERE c.node_lvl = 4 AND c.node_idx >> (3 * (4 - p.node_lvl)) = p.node_idx)")
def j4(spark, sf):
    t = _ladder(spark, sf)
    start = t.where("node_lvl = 4").select("node_idx", "node_lvl")
    return tree.existing(t, tree.ancestors(start).union(start))


@query("J5_anti_leaves", f"WITH {LADDER} SELECT node_idx, node_lvl, n FROM t p WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.node_lvl = p.node_lvl + 1 AND c.node_idx >> 3 = p.node_idx)")
def j5(spark, sf):
    return tree.leaves(_ladder(spark, sf))


@query("J6_distance_join", "WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id < b.vec_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 0.0016::DOUBLE")
def j6(spark, sf):
    return P.distance_join(V.embedding_points(spark, sf), "vec_id", 0.04, 0.0016)


@query("J7_point_in_node", f"WITH {NODES} SELECT node_idx, count(*) AS n FROM keyed JOIN nodes ON node_lvl = 3 AND morton >> 54 = node_idx GROUP BY 1")
def j7(spark, sf):
    pts = V.keyed(spark, sf)[0].withColumn("node_idx", M.node_of(C("morton"), 3))
    wanted = V.nodes(spark, sf)[0].where("node_lvl = 3").select("node_idx")
    return pts.join(wanted, "node_idx").groupBy("node_idx").agg(F.count(F.lit(1)).alias("n"))


@query("J8_file_metadata", f"WITH {PTS}, f AS (SELECT pk % 16 AS file, count(*) AS n, min(x) AS lx FROM pts GROUP BY 1) SELECT {ID_SQL}, n, x - lx AS dx FROM pts JOIN f ON pk % 16 = file")
def j8(spark, sf):
    pts = V.lineitem_points(spark, sf).withColumn("file_id", (C("pk") % 16).cast("int"))
    files = P.catalog(pts, "file_id").select("file_id", "n", "low_x")
    return pts.join(files, "file_id").select(*IDS, "n", (C("x") - C("low_x")).alias("dx"))


# Windows and grouping of the survey's category table


@query("N_rollup_octants", f"WITH {KEYED} SELECT (morton >> 60)::INT AS o0, ((morton >> 57) & 7)::INT AS o1, count(*) AS n FROM keyed GROUP BY ROLLUP (1, 2)")
def n_rollup(spark, sf):
    return V.keyed(spark, sf)[0].rollup(M.octant_at("morton", 0).alias("o0"), M.octant_at("morton", 1).alias("o1")).agg(F.count(F.lit(1)).alias("n"))


@query("N_z_order_neighbours", f"WITH {KEYED} SELECT {ID_SQL}, morton - lag(morton) OVER (PARTITION BY morton >> 57 ORDER BY morton, {ID_SQL}) AS gap FROM keyed")
def n_lag(spark, sf):
    pts = V.keyed(spark, sf)[0]
    w = Window.partitionBy(M.node_of(C("morton"), 2)).orderBy("morton", *IDS)
    return pts.select(*IDS, (C("morton") - F.lag("morton").over(w)).alias("gap"))


FLAGSHIP = f"{tiling_sql('RANDOM_GRID', levels=2)}, seen AS (SELECT node_idx, node_lvl, count(*) AS n_selected FROM stored GROUP BY 1, 2), total AS (SELECT 0::BIGINT AS node_idx, 0 AS node_lvl, count(*) AS n_total FROM rest0 UNION ALL SELECT morton >> 60, 1, count(*) FROM rest1 GROUP BY 1) SELECT 'r' || CASE WHEN node_lvl = 0 THEN '' ELSE node_idx::VARCHAR END AS node_name, n_total, n_selected FROM total JOIN seen USING (node_idx, node_lvl)"


@query("flagship_node_report", FLAGSHIP)
def flagship(spark, sf):
    """Per node of the first two levels: how many points reached it and how many represent it."""
    pts = V.lineitem_points(spark, sf)
    cube = G.bounds_of(pts).cubic()
    ctx = samplers.Context(cube, G.spacing_from_diagonal(cube, FRACTION), CAPACITY, tuple(IDS))
    rest, out = samplers.with_keys(pts, cube), None
    for level in (-1, 0):
        marked = tiling.materialize(tiling.mark_level(rest, level, ctx, samplers.sampler("RANDOM_GRID")), "flagship")
        node = M.name_potree(M.node_of(C("morton"), level + 1), F.lit(level + 1)).alias("node_name")
        report = marked.groupBy(node).agg(F.count(F.lit(1)).alias("n_total"), F.count_if("selected").alias("n_selected"))
        out = report if out is None else out.unionByName(report)
        rest = marked.where("NOT selected").drop("selected")
    return out

"""Queries of the key, geometry and colour functions (M, G, P, K3, R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from octolith.functions import geometry as G
from octolith.functions import morton as M
from octolith.plans import views as V
from octolith.plans.views import EMB, ID_SQL, IDS, KEYED, NODES, PTS, cube_sql, gather, spread

C = F.col
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def over_keys(name: str, columns, sql_columns: str) -> None:
    """A query of columns over all keyed points: columns(cube) -> {name: Column}."""

    def run(spark, sf):
        pts, cube = V.keyed(spark, sf)
        return pts.select(*IDS, *(v.alias(k) for k, v in columns(cube).items()))

    QUERIES[name], SQL[name] = run, f"WITH {KEYED} SELECT {ID_SQL}, {sql_columns} FROM keyed, cube"


def over_nodes(name: str, columns, sql_columns: str) -> None:
    def run(spark, sf):
        nodes, cube = V.nodes(spark, sf)
        return nodes.select("node_idx", "node_lvl", *(v.alias(k) for k, v in columns(cube).items()))

    QUERIES[name], SQL[name] = run, f"WITH {NODES} SELECT node_idx, node_lvl, {sql_columns} FROM nodes, cube"


def over_embeddings(name: str, columns, sql_columns: str) -> None:
    def run(spark, sf):
        return V.embedding_points(spark, sf).select("vec_id", *(v.alias(k) for k, v in columns().items()))

    QUERIES[name], SQL[name] = run, f"WITH {EMB} SELECT vec_id, {sql_columns} FROM emb"


octal = lambda v, n: f"CASE WHEN {n} = 0 THEN '' ELSE lpad(to_base({v}, 8), {n}, '0') END"
over_keys("M1_expand_bits", lambda c: {f"e{a}": M.expand(C(f"q{a}")) for a in "xyz"}, ", ".join(f"{spread(f'q{a}')} AS e{a}" for a in "xyz"))
over_keys("M2_contract_bits", lambda c: {a: M.contract(v) for a, v in zip("xyz", (F.shiftright("morton", 2), F.shiftright("morton", 1), C("morton")), strict=True)}, "qx AS x, qy AS y, qz AS z")
over_keys("M3_morton_encode", lambda c: {"morton": M.encode("x", "y", "z", c)}, "morton")
over_keys("M4_morton_encode_naive", lambda c: {"key6": M.encode_naive("x", "y", "z", G.Bounds((0.0, 0.0, 0.0), (128.0, 128.0, 128.0)), 6)}, f"{spread('trunc(z / 2)::BIGINT')} | ({spread('trunc(y / 2)::BIGINT')} << 1) | ({spread('trunc(x / 2)::BIGINT')} << 2) AS key6")
over_keys("M5_encode_range", lambda c: {"key10": M.encode("x", "y", "z", c, 10)}, "(morton >> 33) AS key10")
over_keys("M6_index_points", lambda c: {"morton": M.encode(*G.clamp(G.Bounds((10.0,) * 3, (60.0,) * 3)), G.Bounds((10.0,) * 3, (60.0,) * 3))}, (lambda q: f"{spread(q('z'))} | ({spread(q('y'))} << 1) | ({spread(q('x'))} << 2) AS morton")(lambda a: f"least(trunc((greatest(10.0::DOUBLE, least(60.0::DOUBLE, {a})) - 10.0::DOUBLE) * (2097152.0::DOUBLE / 50.0))::BIGINT, 2097151)"))
over_keys("M7_octant_at_level", lambda c: {f"o{k}": M.octant_at("morton", k) for k in (0, 1, 7, 20)}, ", ".join(f"((morton >> {3 * (20 - k)}) & 7)::INT AS o{k}" for k in (0, 1, 7, 20)))
over_keys("M8_set_octant", lambda c: {"k": M.set_octant("morton", 3, F.lit(5))}, f"morton | ({5 << 51}) AS k")
over_keys("M9_truncate_to_level", lambda c: {f"t{k}": M.truncate("morton", k) for k in (0, 4, 20)}, ", ".join(f"morton >> {3 * (20 - k)} AS t{k}" for k in (0, 4, 20)))
over_keys("M10_construct_key", lambda c: {"k8": M.from_value("morton", 8), "made": M.from_octants([M.octant_at("morton", k) for k in range(3)])}, f"morton & {2**24 - 1} AS k8, (morton >> 54) << 54 AS made")
over_keys("M11_key_to_string", lambda c: {"name": M.to_string("morton"), "short": M.to_string("morton", 4, prefix="r")}, "lpad(to_base(morton, 8), 21, '0') AS name, 'r' || lpad(to_base(morton >> 51, 8), 4, '0') AS short")
over_keys("M12_key_from_string", lambda c: {"k": M.from_string(M.to_string("morton", 5, prefix="r")), "bad": M.from_string(F.concat(F.lit("9"), M.to_string("morton", 2)))}, "(morton >> 48) << 48 AS k, NULL::BIGINT AS bad")
over_keys("M13_node_from_key", lambda c: {f"n{k}": M.node_of(C("morton"), k) for k in (0, 2, 7, 21)}, "0::BIGINT AS n0, morton >> 57 AS n2, morton >> 42 AS n7, morton AS n21")
over_nodes(
    "M14_node_ordering",
    lambda c: {"less": M.node_less(C("node_idx"), C("node_lvl"), F.lit(20), F.lit(2)), "le": M.node_less_equal(C("node_idx"), C("node_lvl"), F.lit(20), F.lit(2)), "eq": M.node_equal(C("node_idx"), C("node_lvl"), F.lit(2), F.lit(1)), "below": M.is_descendant(C("node_idx"), C("node_lvl"), F.lit(2), F.lit(1))},
    "CASE node_lvl WHEN 1 THEN node_idx < 2 ELSE node_idx >> 3 < 20 END AS less, CASE node_lvl WHEN 1 THEN node_idx <= 2 ELSE node_idx >> 3 <= 20 END AS le, node_idx = 2 AND node_lvl = 1 AS eq, node_idx >> (3 * (node_lvl - 1)) = 2 AS below",
)
over_nodes("M15_node_octant", lambda c: {"o1": M.node_octant(C("node_idx"), C("node_lvl"), F.lit(1)), "own": M.node_octant(C("node_idx"), C("node_lvl"), C("node_lvl")), "o0": M.node_octant(C("node_idx"), C("node_lvl"), F.lit(0))}, "((node_idx >> (3 * (node_lvl - 1))) & 7)::INT AS o1, (node_idx & 7)::INT AS own, 0 AS o0")
over_nodes("M16_parent", lambda c: {"p": M.parent("node_idx", "node_lvl"), "p1": M.parent_at(C("node_idx"), C("node_lvl"), F.lit(1)), "p2": M.parent_at(C("node_idx"), C("node_lvl"), F.lit(2))}, "node_idx >> 3 AS p, node_idx >> (3 * (node_lvl - 1)) AS p1, CASE WHEN node_lvl >= 2 THEN node_idx >> 3 END AS p2")
over_nodes("M17_sibling_child", lambda c: {"s": M.sibling("node_idx", "node_lvl", F.lit(6)), "c": M.child("node_idx", "node_lvl", F.lit(3)), "top": M.sibling(F.lit(0), F.lit(0), F.lit(1))}, "((node_idx >> 3) << 3) | 6 AS s, (node_idx << 3) | 3 AS c, NULL::BIGINT AS top")
over_nodes("M18_node_to_key", lambda c: {"k": M.to_static("node_idx", "node_lvl")}, "node_idx << (3 * (21 - node_lvl)) AS k")
over_nodes("M19_node_grid", lambda c: dict(zip(("gx", "gy", "gz", "back"), (*M.to_grid("node_idx"), M.from_grid(*M.to_grid("node_idx"))), strict=True)), f"{gather('node_idx >> 2')} AS gx, {gather('node_idx >> 1')} AS gy, {gather('node_idx')} AS gz, node_idx AS back")
over_nodes(
    "M20_node_names",
    lambda c: {"simple": M.name_simple("node_idx", "node_lvl"), "potree": M.name_potree("node_idx", "node_lvl"), "entwine": M.name_entwine("node_idx", "node_lvl"), "idx": M.parse_potree(M.name_potree("node_idx", "node_lvl"))[0], "lvl": M.parse_entwine(M.name_entwine("node_idx", "node_lvl"))[1], "bad": M.parse_simple(F.concat(M.name_simple("node_idx", "node_lvl"), F.lit("8")))[1]},
    f"{octal('node_idx', 'node_lvl')} AS simple, 'r' || {octal('node_idx', 'node_lvl')} AS potree, concat_ws('-', node_lvl, {gather('node_idx >> 2')}, {gather('node_idx >> 1')}, {gather('node_idx')}) AS entwine, node_idx AS idx, node_lvl AS lvl, NULL::INT AS bad",
)
_LIST = lambda: M.octants_of(M.name_simple("node_idx", "node_lvl"))
over_nodes("M21_octant_lists", lambda c: {"depth": M.list_depth(_LIST()), "child": M.list_name(M.list_child(_LIST(), F.lit(4))), "parent": M.list_name(M.list_parent(_LIST())), "cut": M.list_name(M.list_truncate(_LIST(), F.lit(2))), "k": M.list_to_static(_LIST())}, f"node_lvl AS depth, {octal('node_idx', 'node_lvl')} || '4' AS child, left({octal('node_idx', 'node_lvl')}, node_lvl - 1) AS parent, left({octal('node_idx', 'node_lvl')}, 2) AS cut, node_idx << (3 * (21 - node_lvl)) AS k")
over_nodes("M22_octant_list_names", lambda c: {"r": M.list_name(_LIST(), "r"), "digits": F.array_join(_LIST().cast("array<string>"), ".")}, f"'r' || {octal('node_idx', 'node_lvl')} AS r, array_to_string(string_split({octal('node_idx', 'node_lvl')}, ''), '.') AS digits")
over_nodes("M23_potree_to_entwine", lambda c: {"name": M.potree_to_entwine(M.name_potree("node_idx", "node_lvl")), "bad": M.potree_to_entwine(F.lit("x12"))}, f"concat_ws('-', node_lvl, {gather('node_idx >> 2')}, {gather('node_idx >> 1')}, {gather('node_idx')}) AS name, NULL::VARCHAR AS bad")
over_keys("M24_previous_power_of_two", lambda c: {"p": M.previous_power_of_two("qx"), "zero": M.previous_power_of_two(F.lit(0))}, "CASE WHEN qx = 0 THEN 0 ELSE (1::BIGINT << floor(log2(qx))::INT) END AS p, 0::BIGINT AS zero")
over_keys("M25_octant_of_position", lambda c: {"o": M.octant_of("x", "y", "z", c.low, c.extent)}, "((least(trunc((x - cx) * 2 / e), 1) * 4) + (least(trunc((y - cy) * 2 / e), 1) * 2) + least(trunc((z - cz) * 2 / e), 1))::INT AS o")

over_embeddings("G1_vector_algebra", lambda: {"a": C("x") + C("y"), "b": C("x") - C("z"), "c": C("x") * C("y"), "d": C("x") * 3.5, "e": C("y") / 2.0}, "x + y AS a, x - z AS b, x * y AS c, x * 3.5::DOUBLE AS d, y / 2 AS e")
over_embeddings("G2_lengths_distances", lambda: {"len": G.length("x", "y", "z"), "sq": G.squared_length("x", "y", "z"), "dist": G.distance(("x", "y", "z"), (1.0, 2.0, 3.0)), "sqd": G.squared_distance(("x", "y", "z"), ("y", "z", "x")), "man": G.manhattan(("x", "y", "z"), (0.5, 0.5, 0.5)), "top": F.greatest("x", "y", "z")}, "sqrt(x * x + y * y + z * z) AS len, x * x + y * y + z * z AS sq, sqrt((x - 1) * (x - 1) + (y - 2) * (y - 2) + (z - 3) * (z - 3)) AS dist, (x - y) * (x - y) + (y - z) * (y - z) + (z - x) * (z - x) AS sqd, abs(x - 0.5::DOUBLE) + abs(y - 0.5::DOUBLE) + abs(z - 0.5::DOUBLE) AS man, greatest(x, y, z) AS top")
over_embeddings("G3_min_max_by_axis", lambda: {"low": F.least("x", "y"), "high": F.greatest("y", "z")}, "least(x, y) AS low, greatest(y, z) AS high")


def _box(b: G.Bounds) -> dict:
    return {f"{n}{a}": F.lit(float(v)) for n, side in (("low_", b.low), ("high_", b.high)) for a, v in zip("xyz", side, strict=True)}


@query("G4_cubic_bounds", f"WITH {PTS}, {cube_sql()} SELECT mx - h AS low_x, my - h AS low_y, mz - h AS low_z, mx + h AS high_x, my + h AS high_y, mz + h AS high_z FROM half")
def g4(spark, sf):
    b = G.bounds_of(V.lineitem_points(spark, sf)).cubic()
    return spark.range(1).select(*(v.alias(k) for k, v in _box(b).items()))


@query("G5_bounds_update", f"WITH {PTS} SELECT min(x) AS low_x, min(y) AS low_y, min(z) AS low_z, max(x) AS high_x, max(y) AS high_y, max(z) AS high_z FROM pts")
def g5(spark, sf):
    pts = V.lineitem_points(spark, sf)
    a, b = (G.bounds_of(pts.where(f"pk % 2 = {k}")) for k in (0, 1))
    return spark.range(1).select(*(v.alias(k) for k, v in _box(a.union(b)).items()))


@query("G6_octant_bounds", f"WITH {PTS}, {cube_sql()} SELECT o::INT AS octant, cx + (o >> 2) * (e / 2) AS low_x, cy + ((o >> 1) & 1) * (ey / 2) AS low_y, cz + (o & 1) * (ez / 2) AS low_z FROM cube, range(8) t(o)")
def g6(spark, sf):
    b = G.bounds_of(V.lineitem_points(spark, sf)).cubic()
    rows = [(o, *map(float, b.octant(o).low)) for o in range(8)]
    return spark.createDataFrame(rows, "octant int, low_x double, low_y double, low_z double")


over_nodes("G7_node_bounds", lambda c: dict(zip(("lx", "ly", "lz", "ext"), (*G.node_low(C("node_idx"), C("node_lvl"), c), G.node_extent(C("node_lvl"), c)), strict=True)), f"cx + {gather('node_idx >> 2')} * (e / pow(2::DOUBLE, node_lvl)) AS lx, cy + {gather('node_idx >> 1')} * (e / pow(2::DOUBLE, node_lvl)) AS ly, cz + {gather('node_idx')} * (e / pow(2::DOUBLE, node_lvl)) AS lz, e / pow(2::DOUBLE, node_lvl) AS ext")
over_nodes("G8_root_bounds", lambda c: dict(zip(("lx", "ly", "lz"), (F.round(v, 6) for v in G.root_low(C("node_idx"), C("node_lvl"), G.node_low(C("node_idx"), C("node_lvl"), c), G.node_extent(C("node_lvl"), c))), strict=True)), "round(cx, 6) AS lx, round(cy, 6) AS ly, round(cz, 6) AS lz")


@query("G9_cubic_at_origin", f"WITH {PTS}, {cube_sql()} SELECT round(-h, 9) AS low_x, round(-h, 9) AS low_y, round(h, 9) AS high_z FROM half")
def g9(spark, sf):
    b = G.bounds_of(V.lineitem_points(spark, sf)).at_origin()
    return spark.range(1).select(F.round(F.lit(b.low[0]), 9).alias("low_x"), F.round(F.lit(b.low[1]), 9).alias("low_y"), F.round(F.lit(b.high[2]), 9).alias("high_z"))


@query("G11_shift_to_centre_f32", f"WITH {EMB}, {cube_sql('emb')}, mid AS (SELECT cx + ((mx + h) - cx) / 2 AS px, cy + ((my + h) - cy) / 2 AS py, cz + ((mz + h) - cz) / 2 AS pz FROM cube, half) SELECT vec_id, (x - px)::FLOAT::DOUBLE AS x, (y - py)::FLOAT::DOUBLE AS y, (z - pz)::FLOAT::DOUBLE AS z FROM emb, mid")
def g11(spark, sf):
    pts = V.embedding_points(spark, sf)
    moved = G.to_centre_f32(G.bounds_of(pts).cubic())
    return pts.select("vec_id", *(v.alias(a) for a, v in zip("xyz", moved, strict=True)))


@query("G12_recentre_per_node", f"WITH {KEYED}, n AS (SELECT *, morton >> 54 AS node FROM keyed) SELECT {ID_SQL}, x - min(x) OVER w AS x, y - min(y) OVER w AS y, z - min(z) OVER w AS z, min(x) OVER w AS ox FROM n WINDOW w AS (PARTITION BY node)")
def g12(spark, sf):
    pts, _ = V.keyed(spark, sf)
    return G.recentre(pts.withColumn("node", M.node_of(C("morton"), 3)), ["node"]).select(*IDS, "x", "y", "z", "ox")


def over_points(name: str, columns, sql_columns: str) -> None:
    def run(spark, sf):
        return V.lineitem_points(spark, sf, True).select(*IDS, *(v.alias(k) for k, v in columns().items()))

    QUERIES[name], SQL[name] = run, f"WITH {PTS} SELECT {ID_SQL}, {sql_columns} FROM pts"


over_points("G13_rgb_16_and_8", lambda: {"up": G.rgb_to_16("r"), "down": G.rgb_to_8("intensity")}, "(r << 8)::INT AS up, (intensity >> 8)::INT AS down")
over_points("G14_intensity_linear", lambda: {"grey": G.grey_linear("intensity")}, "(intensity >> 8)::INT AS grey")
over_points("G15_intensity_log", lambda: {"grey": G.grey_log("intensity")}, "floor(ln((intensity + 1)::DOUBLE)::FLOAT::DOUBLE * 255.0::DOUBLE / ln(65535.0::DOUBLE))::INT AS grey")
over_points("G16_rgba", lambda: {"r": C("r").cast("int"), "a": F.lit(255)}, "r, 255 AS a")
over_nodes("G17_bounding_box", lambda c: (lambda low, e: {"box": G.box_volume(low, [v + e for v in low])})(G.node_low(C("node_idx"), C("node_lvl"), c), G.node_extent(C("node_lvl"), c)), (lambda lo: "[" + ", ".join([f"({v} + ({v} + s)) / 2" for v in lo] + [f"(({lo[0]} + s) - {lo[0]}) / 2", "0", "0", "0", f"(({lo[1]} + s) - {lo[1]}) / 2", "0", "0", "0", f"(({lo[2]} + s) - {lo[2]}) / 2"]) + "]::DOUBLE[] AS box")(("lx", "ly", "lz")))
SQL["G17_bounding_box"] = SQL["G17_bounding_box"].replace(" FROM nodes, cube", f" FROM (SELECT *, cx + {gather('node_idx >> 2')} * s AS lx, cy + {gather('node_idx >> 1')} * s AS ly, cz + {gather('node_idx')} * s AS lz FROM (SELECT *, e / pow(2::DOUBLE, node_lvl) AS s FROM nodes, cube))")
over_nodes("G19_geometric_error", lambda c: {"err": G.geometric_error(F.lit(8.0), C("node_lvl")), "twice": G.geometric_error(F.lit(8.0), C("node_lvl")) * 2}, "8.0::DOUBLE / pow(2::DOUBLE, node_lvl) AS err, 16.0::DOUBLE / pow(2::DOUBLE, node_lvl) AS twice")
over_keys("G20_candidate_level", lambda c: {"lvl": G.candidate_level_column(F.lit(c.extent), (C("z") + 0.5) / 4)}, "greatest(-1, floor(log2((e / ((z + 0.5::DOUBLE) / 4))::FLOAT::DOUBLE)::FLOAT)::INT - 1) AS lvl")


@query("G22_spacing_from_diagonal", f"WITH {PTS}, {cube_sql()} SELECT (sqrt(e * e + ey * ey + ez * ez) / 250)::FLOAT::DOUBLE AS spacing FROM cube")
def g22(spark, sf):
    return spark.range(1).select(F.lit(G.spacing_from_diagonal(G.bounds_of(V.lineitem_points(spark, sf)).cubic())).alias("spacing"))


over_points("G23_align", lambda: {"a": G.align("intensity", 8), "b": G.align("sk", 3)}, "((intensity + 7) // 8 * 8)::BIGINT AS a, ((sk + 2) // 3 * 3)::BIGINT AS b")


@query("G24_string_helpers", "SELECT p_partkey, upper(p_name) AS u, trim('  ' || p_name || ' ') AS t, suffix(p_type, 'L') AS e, p_brand ILIKE '%brand#1%' AS i, sign(p_retailprice - 1000)::DOUBLE AS s FROM part")
def g24(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("u"), F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("t"), F.endswith(C("p_type"), F.lit("L")).alias("e"), C("p_brand").ilike("%brand#1%").alias("i"), F.signum(C("p_retailprice") - 1000).alias("s"))


def _prefix_sql(q: str, prefixes, precision: int = 3) -> str:
    cases = " ".join(f"WHEN {q} >= {f!r}::DOUBLE THEN printf('%.{precision}f', {q} / {f!r}::DOUBLE) || '{p}'" for p, f in reversed(prefixes[1:]))
    return f"CASE WHEN {q} = 0 THEN '0' {cases} ELSE printf('%.{precision}f', {q} / {prefixes[0][1]!r}::DOUBLE) || '{prefixes[0][0]}' END"


over_points("G25_unit_prefixes", lambda: {"m": G.with_prefix(C("y") * 1024 * 16, 3, G.METRIC), "b": G.with_prefix(C("intensity"), 1, G.BINARY), "s": G.with_prefix(C("x") / 65536, 3, G.METRIC)}, f"{_prefix_sql('(y * 1024 * 16)', G.METRIC)} AS m, {_prefix_sql('intensity::DOUBLE', G.BINARY, 1)} AS b, {_prefix_sql('(x / 65536)', G.METRIC)} AS s")
over_points("G26_parse_size", lambda: {"k": G.parse_size(F.concat(C("intensity").cast("string"), F.lit("KiB"))), "m": G.parse_size(F.concat(C("sk").cast("string"), F.lit("MB"))), "bad": G.parse_size(F.lit("12 parsecs"))}, "intensity::BIGINT * 1024 AS k, sk * 1000000 AS m, NULL::BIGINT AS bad")
over_points("G27_parse_number", lambda: {"ok_": C("sk").cast("string").try_cast("tinyint").cast("int"), "bad": F.concat(C("sk").cast("string"), F.lit("x")).try_cast("int")}, "CASE WHEN sk <= 127 THEN sk END::INT AS ok_, NULL::INT AS bad")
over_points("G29_concat", lambda: {"c": F.concat_ws("/", "ok", "ln")}, "concat_ws('/', ok, ln) AS c")
over_nodes("K3_las_scale", lambda c: {"s": G.las_scale(G.node_extent(C("node_lvl"), c) * (C("n") % 3) * 30000.0)}, "CASE WHEN e / pow(2::DOUBLE, node_lvl) * (n % 3) * 30000 > 1e6 THEN 0.01 WHEN e / pow(2::DOUBLE, node_lvl) * (n % 3) * 30000 > 1 THEN 0.001 ELSE 0.0001 END::DOUBLE AS s")

over_points("P1_projection", lambda: {"x": C("x"), "intensity": C("intensity")}, "x, intensity")


@query("P2_apply_schema", f"WITH {PTS} SELECT {ID_SQL}, x, y, z, intensity, 0::DOUBLE AS gps_time FROM pts")
def p2(spark, sf):
    from octolith import schema

    return schema.apply_schema(V.lineitem_points(spark, sf, True), {"POSITION", "INTENSITY", "GPS_TIME"}, IDS)


@query("P3_append", f"WITH {PTS} SELECT {ID_SQL}, x, y, z, r, g, b, 0 AS intensity FROM pts WHERE pk % 2 = 0 UNION ALL SELECT {ID_SQL}, x, y, z, 0, 0, 0, intensity FROM pts WHERE pk % 2 = 1")
def p3(spark, sf):
    from octolith import schema

    pts = V.lineitem_points(spark, sf, True)
    return schema.append(pts.where("pk % 2 = 0").select(*IDS, "x", "y", "z", "r", "g", "b"), pts.where("pk % 2 = 1").select(*IDS, "x", "y", "z", "intensity"))


over_points("P11_point_in_box", lambda: {"inside": G.inside(G.Bounds((20.0, 10.0, 5.0), (60.0, 70.0, 80.0)))}, "x BETWEEN 20 AND 60 AND y BETWEEN 10 AND 70 AND z BETWEEN 5 AND 80 AS inside")
over_points("P12_clamp_to_bounds", lambda: dict(zip("xyz", G.clamp(G.Bounds((20.0, 10.0, 5.0), (60.0, 70.0, 80.0))), strict=True)), "greatest(20.0::DOUBLE, least(60.0::DOUBLE, x)) AS x, greatest(10.0::DOUBLE, least(70.0::DOUBLE, y)) AS y, greatest(5.0::DOUBLE, least(80.0::DOUBLE, z)) AS z")
over_points("P13_header_clamp", lambda: dict(zip("xyz", G.clamp(G.Bounds((2.0, 1.0, 0.5), (99.0, 99.5, 99.0))), strict=True)), "greatest(2.0::DOUBLE, least(99.0::DOUBLE, x)) AS x, greatest(1.0::DOUBLE, least(99.5::DOUBLE, y)) AS y, greatest(0.5::DOUBLE, least(99.0::DOUBLE, z)) AS z")

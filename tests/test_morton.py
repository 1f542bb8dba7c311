"""Keys and node keys against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from octolith.functions import geometry as G
from octolith.functions import morton as M


def py_encode(q, levels=21):
    return sum((q[k] >> i & 1) << (3 * i + 2 - k) for k in range(3) for i in range(levels))


def one(spark, **columns):
    return spark.range(1).select(*(v.alias(k) for k, v in columns.items())).first()


def test_expand_and_contract(spark):
    rng = random.Random(1)
    values = [0, 1, 2**21 - 1, *(rng.randrange(2**21) for _ in range(300))]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    for r in df.select("v", M.expand("v").alias("e"), M.contract(M.expand("v")).alias("c")).collect():
        assert r.e == sum((r.v >> i & 1) << 3 * i for i in range(21)) and r.c == r.v


#: Corners of the unit cube's octants that fix the octant convention (fixed values).
PROBES = [((0.25, 0.25, 0.25), 0), ((0.25, 0.25, 0.75), 1), ((0.25, 0.75, 0.25), 2), ((0.75, 0.25, 0.25), 4)]


def test_octant_probes(spark):
    cube = G.Bounds((0.0,) * 3, (1.0,) * 3)
    df = spark.createDataFrame([(*p, o) for p, o in PROBES], "x double, y double, z double, o int")
    for r in df.select("o", M.encode("x", "y", "z", cube, 1).alias("k"), M.octant_of("x", "y", "z", cube.low, 1.0).alias("p")).collect():
        assert r.k == r.o == r.p


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_random_paths_and_naive(spark, seed):
    rng = random.Random(seed)
    depth = rng.randrange(8, 21)
    path = [rng.randrange(8) for _ in range(depth)]
    cube = G.Bounds((0.0,) * 3, (2.0**depth,) * 3)
    at = [sum((o >> (2 - k) & 1) << (depth - 1 - i) for i, o in enumerate(path)) + 0.5 for k in range(3)]
    df = spark.createDataFrame([tuple(at)], "x double, y double, z double")
    r = df.select(M.encode("x", "y", "z", cube, depth).alias("k"), M.encode_naive("x", "y", "z", cube, depth).alias("n")).first()
    assert r.k == r.n == int("".join(map(str, path)), 8)


def test_expressions_stay_linear(spark):
    """A key of a key of a position is planned in a text that grows with the steps, not with their power."""
    size = lambda c: len(spark.range(1).select(c.alias("v"))._jdf.queryExecution().optimizedPlan().toString())
    once, twice = size(M.expand(F.col("id"))), size(M.expand(M.contract(M.expand(F.col("id")))))
    assert twice < 40 * once


def test_clamped_and_flat_bounds(spark):
    cube = G.Bounds((0.0,) * 3, (4.0,) * 3)
    df = spark.createDataFrame([(-5.0, 9.0, 4.0)], "x double, y double, z double")
    assert df.select(M.encode("x", "y", "z", cube, 3).alias("k")).first().k == py_encode((0, 7, 7), 3)
    assert df.select(M.encode("x", "y", "z", G.Bounds((1.0,) * 3, (1.0,) * 3)).alias("k")).first().k == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_fixed_depth_keys(spark, seed):
    rng = random.Random(seed)
    octants, digits = [rng.randrange(8) for _ in range(5)], "".join(str(rng.randrange(8)) for _ in range(8))
    made, text = M.from_octants([F.lit(o) for o in octants], 5), "".join(map(str, octants))
    r = one(spark, k=made, o=M.octant_at(made, 2, 5), t=M.truncate(made, 1, 5), s=M.to_string(made, 5, 5), m=M.from_value(F.lit(255), 2), b=M.from_string(F.lit("r" + digits), 8), p=M.to_string(M.from_string(F.lit(digits), 8), 8, 8, "r"))
    assert (r.k, r.o, r.t, r.s, r.m, r.p) == (int(text, 8), octants[2], int(text[:2], 8), text, 63, "r" + digits) and r.b == int(digits, 8)
    assert one(spark, k=M.set_octant(F.lit(0), 2, F.lit(5), 4)).k == 5 << 3


def test_node_order_of_ancestors(spark):
    deep = [1, 2, 3, 4, 5] + [1] * 15 + [6]
    idx = int("".join(map(str, deep)), 8)
    a, la, b, lb = F.lit(idx), F.lit(21), F.lit(int("12345", 8)), F.lit(5)
    r = one(spark, eq=M.node_equal(a, la, b, lb), less=M.node_less(a, la, b, lb), more=M.node_less(b, lb, a, la), le=M.node_less_equal(a, la, b, lb), ge=M.node_less_equal(b, lb, a, la), below=M.is_descendant(a, la, b, lb))
    assert (r.eq, r.less, r.more, r.le, r.ge, r.below) == (False, False, False, True, True, True)


def test_family(spark):
    n, lvl = F.lit(0o1234), F.lit(4)
    r = one(spark, p=M.parent(n, lvl), a=M.parent_at(n, lvl, F.lit(2)), deep=M.parent_at(n, lvl, F.lit(5)), s=M.sibling(n, lvl, F.lit(7)), c=M.child(n, lvl, F.lit(5)), top=M.parent(F.lit(0), F.lit(0)), end=M.child(F.lit(0), F.lit(21), F.lit(1)), o=M.node_octant(n, lvl, F.lit(2)))
    assert (r.p, r.a, r.deep, r.s, r.c, r.top, r.end, r.o) == (0o123, 0o12, None, 0o1237, 0o12345, None, None, 2)


@pytest.mark.parametrize(("name", "want"), [("", (0, 0)), ("0" * 21, (0, 21)), ("7" * 21, (2**63 - 1, 21)), ("invalid", (None, None)), ("0" * 22, (None, None))])
def test_simple_names(spark, name, want):
    idx, lvl = M.parse_simple(F.lit(name))
    r = one(spark, i=idx, l=lvl)
    assert (r.i, r.l) == want


def test_entwine_names(spark):
    idx, lvl = M.parse_entwine(F.lit("13-410-7041-4059"))
    r = one(spark, name=M.name_simple(idx, lvl), back=M.name_entwine(idx, lvl), bad=M.parse_entwine(F.lit("22-0-0-0"))[1], few=M.parse_entwine(F.lit("1-0-0"))[1], wide=M.parse_entwine(F.lit("1-2-0-0"))[1], potree=M.potree_to_entwine(F.lit("r")))
    assert (r.name, r.back, r.bad, r.few, r.wide, r.potree) == ("2313771055053", "13-410-7041-4059", None, None, None, "0-0-0-0")


def test_lists(spark):
    o = M.octants_of(F.lit("120"))
    r = one(spark, d=M.list_depth(o), c=M.list_name(M.list_child(o, F.lit(7)), "r"), p=M.list_name(M.list_parent(o)), t=M.list_name(M.list_truncate(o, F.lit(1))), k=M.list_to_static(o), e=M.list_depth(M.octants_of(F.lit(""))), root=M.list_parent(M.octants_of(F.lit(""))))
    assert (r.d, r.c, r.p, r.t, r.k, r.e, r.root) == (3, "r1207", "12", "1", 0o120 << 54, 0, None)


def test_powers(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 1023, 1024, 2**40 + 5)], "v bigint")
    got = [r.p for r in df.select(M.previous_power_of_two("v").alias("p")).collect()]
    assert got == [0, 1, 2, 2, 4, 512, 1024, 2**40]

import pytest
from pyspark.sql import functions as F

from octolith.functions import morton as M
from octolith.operators import tree as T


@pytest.fixture
def nodes(spark):
    return lambda names: spark.createDataFrame([(int(n or "0", 8), len(n), v) for n, v in names.items()], "node_idx bigint, node_lvl int, v string")


def names(df):
    return {r.n: r.v for r in df.select(M.name_simple("node_idx", "node_lvl").alias("n"), "v").collect()}


def test_insert_makes_ancestors_and_siblings(nodes):
    got = names(T.densify(nodes({"1": "A", "16": "B"})))
    assert set(got) == {"", *map(str, range(8)), *(f"1{k}" for k in range(8))} and got["16"] == "B" and got[""] is None and len(got) == 17
    order = [r.n for r in T.level_order(T.densify(nodes({"1": "A", "16": "B"}))).select(M.name_simple("node_idx", "node_lvl").alias("n")).collect()]
    assert order == ["", *map(str, range(8)), *(f"1{k}" for k in range(8))]
    pre = [r.n for r in T.pre_order(nodes({"": "R", "1": "A", "16": "B", "2": "C"})).select(M.name_simple("node_idx", "node_lvl").alias("n")).collect()]
    assert pre == ["", "1", "16", "2"]


def test_erase(nodes):
    got = names(T.erase(nodes({"": "R", "1": "A", "16": "B", "2": "C"}), 1, 1))
    assert got == {"": "R", "1": None, "2": "C"}
    assert names(T.erase(nodes({"": "R", "1": "A"}), 0, 0)) == {"": None}


def test_merge(nodes):
    a, b = nodes({"": "RA", "1": "1A", "2": "2A"}), nodes({"": "RB", "1": "1B", "6": "6B"})
    both = F.concat(F.coalesce("a.v", F.lit("")), F.coalesce("b.v", F.lit("")))
    assert names(T.merge(a, b, {"v": both})) == {"": "RARB", "1": "1A1B", "2": "2A", "6": "6B"}
    assert T.differences(a, a).count() == 0 and T.differences(a, b).count() == 6


def test_relations(nodes):
    t = nodes({"": "R", "1": "A", "16": "B", "17": "C", "2": "D"})
    assert names(T.leaves(t)) == {"16": "B", "17": "C", "2": "D"}
    assert sorted((r.node_idx, r.child_idx) for r in T.children(t).collect()) == [(0, 1), (0, 2), (1, 0o16), (1, 0o17)]
    assert sorted((r.node_idx, r.sibling_idx) for r in T.siblings(t).where("node_lvl = 2").collect()) == [(0o16, 0o17), (0o17, 0o16)]
    assert sorted((r.node_idx, r.node_lvl) for r in T.ancestors(t).collect()) == [(0, 0), (1, 1)]
    assert T.at(t, 1, 1).first().v == "A" and T.existing(t, T.at(t, 1, 1)).count() == 1


def test_hierarchy_links(nodes):
    t = nodes({"": "1", "1": "2", "11": "3", "111": "4"}).withColumn("n", F.col("v").cast("bigint"))
    got = sorted((r.root_lvl, r.node_lvl, r.n) for r in T.hierarchy(t, 2).collect())
    assert got == [(0, 0, 1), (0, 1, 2), (0, 2, -1), (2, 2, 3), (2, 3, 4)]
    lines = [r.line for r in T.graphviz(t).collect()]
    assert len(lines) == 7 and '"r1" -> "r11";' in lines

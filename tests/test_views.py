"""Node counts of the queries."""

from octolith.plans import dataflows
from octolith.plans import views as V
from tests.conftest import SF


def test_names_are_made_for_nodes_not_points(spark):
    """Filters on node names don't get down to the points, and a query reads counts, not line items."""
    plan = dataflows.QUERIES["S22_node_files"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_quantity" not in plan and "RLIKE" in plan.upper()
    nodes, _ = V.nodes(spark, SF, (0, 2))
    got = nodes.groupBy("node_lvl").sum("n").collect()
    assert {r.node_lvl: r["sum(n)"] for r in got} == {0: 6000, 2: 6000}

"""Registry of queries and their SQL."""

from __future__ import annotations

from octolith.plans import dataflows, formats, scalars

FAMILIES = [scalars, dataflows, formats]


def queries():
    return {k: f for m in FAMILIES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in FAMILIES for k, s in m.SQL.items()}


def flagship(spark, sf_dir):
    return dataflows.flagship(spark, sf_dir)

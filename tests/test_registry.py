"""The registry against DuckDB on the smallest tables, for a part of the queries; the driver runs all of them."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

SOME = ["flagship_node_report", "M3_morton_encode", "M20_node_names", "TA7_A1_accurate_random_grid", "TA8_fast_random_grid", "T1_densify", "K1_S15_bin_round_trip", "ST3_single_batch_equals_batch_mode", "J6_distance_join", "R2_to_geocentric"]


def text(v):
    return None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = sorted(c[0] for c in cur.description)
    at = {c[0]: i for i, c in enumerate(cur.description)}
    want = sorted((tuple(text(r[at[c]]) for c in columns) for r in cur.fetchall()), key=str)
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted((tuple(text(r[c]) for c in columns) for r in df.collect()), key=str) == want


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 1

"""A part of the catalogue against its SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from ripplekit.catalog import ORACLE_SQL, QUERIES  # noqa: E402

DIR = "/root/testdata/sf0.001"
NAMES = ["s01_multigraph_reader", "s06_adjacency_reader", "e01_clean_graph", "e03_prune", "m05_degree_categories", "d02_cascade_levels", "d05_expected_spread", "d06_linear_threshold", "w02_components", "w04_strong_components", "k04_degree_discount", "k09_new_greedy", "z11_reverse_degree", "r01_spanning_forest", "r04_mc_reliability", "r22_redistribute", "h06_graph_statistics", "w13_greedy_world", "w16_forest_world", "k13_continuous_search", "r03_forest_reliability", "r09_forest_order", "r14_shortest_paths", "r15b_forest_leaves", "r16_forest_power", "r17_greedy_degree_loss"]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    got = QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    done = con.execute(ORACLE_SQL[name])
    at = [[d[0] for d in done.description].index(c) for c in cols]
    want = sorted(tuple(r[i] for i in at) for r in done.fetchall())
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == want


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)

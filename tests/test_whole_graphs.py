"""Queries that run on the whole graph: against SQL without the row filters, and the operators on unfiltered arcs."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from pyspark.sql import functions as F  # noqa: E402

from ripplekit.catalog import ORACLE_SQL, QUERIES  # noqa: E402
from ripplekit.operators import local_trees as T  # noqa: E402
from ripplekit.plans.oracles import with_blocks  # noqa: E402
from ripplekit.schema import event_graph  # noqa: E402

DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
RELABELLED = with_blocks(
    "SELECT a.new AS src, b.new AS dst, e.event_id AS action FROM ev e JOIN first b ON b.old = e.dst LEFT JOIN first a ON a.old = e.src WHERE e.src IS NULL OR (a.new IS NOT NULL AND e.src <> e.dst)", "first",
    extra="ev AS (SELECT CASE WHEN event_id % 3 <> 0 THEN user_id + 1 END AS src, user_id AS dst, event_id FROM events)",
)
WHOLE = {
    "e02_relabel_actions": RELABELLED,
    "s09_edge_probability_reader": ORACLE_SQL["s09_edge_probability_reader"].replace(" WHERE w > 1", ""),
    "e07_spread_edges": ORACLE_SQL["e07_spread_edges"].replace("e.w > 2 AND ", ""),
    "h06_graph_statistics": ORACLE_SQL["h06_graph_statistics"].replace(" WHERE w > 1", ""),
}


@pytest.mark.parametrize("name", WHOLE)
def test_query_equals_sql_of_the_whole_graph(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    got = QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    done = con.execute(WHOLE[name])
    at = [[d[0] for d in done.description].index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in done.fetchall()), key=str)
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=str) == want


@pytest.mark.parametrize("name", ["k21_pmia", "k22_ldag", "z10_reverse_pmia"])
def test_local_structures_get_every_arc(spark, monkeypatch, name):
    seen = []
    monkeypatch.setattr(T, "ldag" if name == "k22_ldag" else "pmia", lambda arcs, k, *a: seen.append(arcs) or spark.createDataFrame([(1, 0, 0.0)], "rank int, node long, score double"))
    QUERIES[name](spark, DIR)
    arcs = event_graph(spark, DIR).where("src <> dst").select("src", "dst")
    want = arcs.union(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct() if name == "z10_reverse_pmia" else arcs
    assert seen[0].count() == want.count()

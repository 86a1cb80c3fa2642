"""Toy graphs with answers in closed form."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplekit.functions import kernels, stats
from ripplekit.operators import diffusion as D
from ripplekit.operators import local_trees as T
from ripplekit.operators import minimize as Z
from ripplekit.operators import models as M
from ripplekit.operators import reliability as R
from ripplekit.operators import selection as K
from ripplekit.operators import sparsify as X
from ripplekit.operators import worlds as W
from ripplekit.schema import both_ways

DAG = [(1, 2), (2, 3), (3, 4), (2, 5), (5, 6), (4, 7), (6, 7), (8, 9), (8, 10), (9, 10), (11, 12), (11, 13), (12, 14), (13, 14)]
PROTEIN = [(0, 2, 0.3), (1, 2, 0.3), (3, 4, 0.3), (3, 5, 0.3), (2, 3, 0.2), (0, 4, 0.1), (4, 5, 0.15), (5, 6, 0.5)]


def edges(spark, rows, schema="src long, dst long, w long"):
    return spark.createDataFrame([(*r, 1) if len(r) == 2 else r for r in rows], schema)


def test_topological_order_puts_heads_first():
    assert T.topological({1: [0], 3: [0, 1], 4: [1, 3], 5: [3]}) == [0, 1, 3, 4, 5]
    with pytest.raises(ValueError):
        T.topological({1: [2], 2: [1]})


def test_reach_sizes_of_a_dag(spark):
    live = edges(spark, DAG).select(F.lit(0).alias("world"), "src", "dst")
    want = {1: 7, 2: 6, 3: 3, 4: 2, 5: 3, 6: 2, 7: 1, 8: 3, 9: 2, 10: 1, 11: 4, 12: 2, 13: 2, 14: 1}
    for method in ("topsort", "bfs"):
        assert {r["node"]: r["size"] for r in W.reach_sizes(live, method).collect()} == want


def test_strong_components_against_mutual_reach():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 9, 14), rng.integers(0, 9, 14)
        g = kernels.Arcs(a, b)
        sets = [set(np.flatnonzero(kernels.levels(g, np.array([v])) >= 0)) for v in range(g.n)]
        want = [min(u for u in range(g.n) if u in sets[v] and v in sets[u]) for v in range(g.n)]
        assert kernels.strong(g).tolist() == want
        assert kernels.reach_sets(g) == sets


def test_components_by_joins_equal_the_kernel(spark):
    rng = np.random.default_rng(2)
    rows = [(int(w), int(a), int(b)) for w, a, b in zip(rng.integers(0, 3, 60), rng.integers(0, 40, 60), rng.integers(0, 40, 60))]
    live = spark.createDataFrame(rows, "world int, src long, dst long")
    assert set(W.components(live, kernel=True).collect()) == set(W.components(live, kernel=False).collect())


def test_reach_by_joins_equals_the_kernel(spark):
    live = edges(spark, DAG).select(F.lit(0).alias("world"), "src", "dst")
    seeds = spark.createDataFrame([(2,), (11,)], "node long")
    assert set(W.reach(live, seeds, 2, kernel=True).collect()) == set(W.reach(live, seeds, 2, kernel=False).collect())


@pytest.mark.parametrize(("rows", "pair", "want"), [([(0, 1, 0.5), (1, 2, 0.1), (0, 2, 1.0)], (0, 1), 0.55), ([(0, 1, 0.5)], (0, 1), 0.5), (PROTEIN, (2, 3), 0.207956)])
def test_sampled_reliability_is_near_the_exact_value(spark, rows, pair, want):
    pairs = spark.createDataFrame([pair], "u long, v long")
    got = R.sampled_reliability(edges(spark, rows, "src long, dst long, p double"), 3000, pairs).head()["r"]
    assert abs(got - want) < 0.03


def test_spanning_forest_and_tree_reliability(spark):
    tree = edges(spark, [(1, 2, 0.5), (1, 4, 0.5), (2, 4, 0.5), (3, 4, 0.5), (4, 5, 0.5), (5, 7, 0.5), (5, 6, 0.5)], "src long, dst long, p double")
    forest = R.spanning_forest(tree)
    assert forest.count() == 6
    pairs = spark.createDataFrame([(6, 7), (3, 7), (1, 9)], "u long, v long")
    assert [round(r["r"], 6) for r in R.tree_reliability(forest, pairs).orderBy("u", "v").collect()] == [0.0, 0.125, 0.25]


def test_chung_lu_path(spark):
    got = {(r["u"], r["v"]): round(r["p"], 6) for r in X.chung_lu(edges(spark, [(0, 1, 0.1), (1, 2, 0.2)], "src long, dst long, p double")).collect()}
    assert got[0, 1] == 0.05 and got[1, 2] == 0.1 and got[1, 1] == 0.075


def test_linear_threshold_by_joins_equals_the_kernel(spark):
    rng = np.random.default_rng(3)
    rows = list({(int(a), int(b)) for a, b in zip(rng.integers(0, 12, 50), rng.integers(0, 12, 50)) if a != b})
    weighted = M.uniform_weights(edges(spark, rows))
    seeds = spark.createDataFrame([(rows[0][0],)], "node long")
    x = weighted.select("src", "dst", F.round(F.col("b") * F.col("w"), 12).alias("x"))
    want = set(D._linear_threshold_by_joins(x, seeds, 3, 50, 42).collect())
    assert set(D.linear_threshold(weighted, seeds, 3).select("world", "node", "level").collect()) == want


def test_spread_never_falls_with_more_seeds(spark):
    arcs = both_ways(edges(spark, [(a, b, 3) for a, b in DAG]))
    curve = D.spread_curve(arcs, K.top_degree(arcs, 5), 30, 0.1).orderBy("k").collect()
    assert all(a["spread"] <= b["spread"] for a, b in zip(curve, curve[1:]))


def test_weights_pass_the_threshold_check(spark):
    arcs = both_ways(edges(spark, DAG))
    assert M.overweight(M.uniform_weights(arcs)).count() == 0
    assert M.overweight(M.random_weights(arcs)).count() == 0


def test_discount_picks_the_second_star_not_a_leaf(spark):
    star = [(0, i) for i in range(1, 8)] + [(20, i) for i in range(21, 26)] + [(0, 20)]
    seeds = K.degree_discount(both_ways(edges(spark, star)), 2).orderBy("rank").collect()
    assert [r["node"] for r in seeds] == [0, 20]


def test_pmia_and_ldag_pick_the_hubs(spark):
    arcs = edges(spark, [(0, i) for i in range(1, 8)] + [(20, i) for i in range(21, 26)])
    assert [r["node"] for r in T.pmia(M.uniform(arcs, 0.5), 2).orderBy("rank").collect()] == [0, 20]
    assert [r["node"] for r in T.ldag(M.uniform_weights(arcs), 2).orderBy("rank").collect()] == [0, 20]


def test_first_pmia_gain_is_the_tree_sum(spark):
    path = M.uniform(edges(spark, [(0, 1), (1, 2), (2, 3)]), 0.5)
    best = T.pmia(path, 1, 0.01).head()
    assert (best["node"], round(best["score"], 6)) == (0, 1.875)


def test_representative_worlds_keep_expected_degrees(spark):
    sure = edges(spark, [(a, b, 0.5) for a in range(8) for b in range(a + 1, 8)], "src long, dst long, p double")
    for make in (X.greedy_world, X.rewired_world, X.matched_world):
        world = make(sure)
        degree = world.select(F.explode(F.array("src", "dst")).alias("n")).groupBy("n").count().collect()
        assert all(abs(r["count"] - 3.5) <= 2 for r in degree)
        assert set(make(sure).collect()) == set(world.collect())
    assert X.forest_world(sure).count() == 15  # the first count above sum p = 14


def test_pruned_forests_have_k_edges_and_power_keeps_leaves():
    path = [(i, i + 1, 0.5 + i / 100) for i in range(9)]
    assert len(X.prune_leaves(path, 4)) == 4
    left = X.prune_power(path, 6)
    assert len(left) == 6 and (0, 1) in {e[:2] for e in left}


def test_lp_solution_is_feasible(spark):
    sure = edges(spark, PROTEIN, "src long, dst long, p double")
    d = X.expected_degrees(sure)
    solved = X.expected_degrees(X.fill_degrees(sure, d)).withColumnRenamed("d", "have").join(d, "node")
    assert solved.where("have > d + 1e-9").count() == 0


def test_search_replay():
    assert Z.probes(lambda k: float(k), 5.0, 100)[0] == 5


def test_priority_queue():
    q = stats.PriorityQueue()
    for t, p in (("a", 2), ("b", 1), ("c", 1)):
        q.add_task(t, p)
    q.add_task("b", 3)
    q.remove_task("a")
    assert q.pop_item() == ("c", 1) and q.pop_item() == ("b", 3)
    with pytest.raises(KeyError):
        q.pop_item()
    with pytest.raises(KeyError):
        q.remove_task("a")


def test_linear_threshold_runs_past_the_rounds_of_its_sql(spark):
    path = M.uniform_weights(edges(spark, [(i, i + 1) for i in range(60)]))
    seeds = spark.createDataFrame([(0,)], "node long")
    assert {r["node"]: r["level"] for r in D.linear_threshold(path, seeds, 1).collect()} == {i: i for i in range(61)}


def test_reach_counts_take_bounded_memory():
    rng = np.random.default_rng(3)
    for _ in range(30):
        g = kernels.Arcs(rng.integers(0, 12, 18), rng.integers(0, 12, 18))
        want = [len(s) for s in kernels.reach_sets(g)]
        for parts, words in ((1, 1 << 22), (3, 1)):
            assert sum(kernels.reach_counts(g, p, parts, words) for p in range(parts)).tolist() == want
    path = kernels.Arcs(np.arange(3000), np.arange(1, 3001))  # 4.5 million pairs; as sets over 150 MB
    tracemalloc.start()
    assert kernels.reach_counts(path, words=1 << 15).tolist() == list(range(3001, 0, -1))
    assert tracemalloc.get_traced_memory()[1] < 8e6
    tracemalloc.stop()


def test_reach_sizes_by_parts(spark, monkeypatch):
    live = edges(spark, DAG).select(F.lit(0).alias("world"), "src", "dst")
    want = set(W.reach_sizes(live, "bfs").collect())
    monkeypatch.setattr(W, "COUNT_ARCS", 5)
    assert set(W.reach_sizes(live, "topsort").collect()) == want


def test_diameters_take_few_searches(monkeypatch):
    rng = np.random.default_rng(4)
    search, calls = kernels.levels, []
    for _ in range(60):
        a, b = rng.integers(0, 14, 16), rng.integers(0, 14, 16)
        node, comp = kernels.components(a, b)
        own = np.isin(a, node[comp == comp[0]])
        g = kernels.Arcs(np.concatenate([a[own], b[own]]), np.concatenate([b[own], a[own]]))
        assert kernels.diameter(g) == max(search(g, np.array([v])).max() for v in range(g.n))
    i, j = np.divmod(np.arange(900), 30)
    right, down = np.arange(900)[j < 29], np.arange(900)[i < 29]
    a, b = np.concatenate([right, down]), np.concatenate([right + 1, down + 30])
    monkeypatch.setattr(kernels, "levels", lambda g, seeds: calls.append(1) or search(g, seeds))
    assert kernels.diameter(kernels.Arcs(np.concatenate([a, b]), np.concatenate([b, a]))) == 58
    assert len(calls) < 100  # of 900 nodes


def plain_greedy(states, nodes, k):
    """k picks over {root: state rows} that states(seeds) makes."""
    seeds, taken = [], []
    for rank in range(1, k + 1):
        gains = dict.fromkeys(nodes, 0.0)
        for rows in states(seeds):
            for _, node, _, _, gain in rows:
                gains[node] += gain
        score, node = min((-round(g, 9), n) for n, g in gains.items() if n not in seeds)
        seeds = [*seeds, node]
        taken.append((rank, node, pytest.approx(-score, abs=1e-8)))
    return taken


@pytest.fixture(scope="module")
def weighted(spark):
    rng = np.random.default_rng(11)
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 14, 45), rng.integers(0, 14, 45)) if a != b})
    return M.uniform_weights(edges(spark, [(a, b, 1 + (a * b) % 4) for a, b in pairs])).withColumn("p", F.col("b") * F.col("w"))


@pytest.mark.parametrize("name", ["pmia", "ldag"])
def test_local_structures_of_graphs_of_any_size_equal_a_plain_search(spark, weighted, monkeypatch, name):
    monkeypatch.setattr(T, "MOST_ARCS", 0, raising=False)  # once refused beyond that
    into: dict = {}
    for r in weighted.orderBy("dst", "src").collect():
        into.setdefault(r["dst"], []).append((r["src"], r["p"]))
    nodes = sorted({n for v, rows in into.items() for n in (v, *[u for u, _ in rows])})

    def trees(seeds):
        out = []
        for v in nodes:
            barred = set()
            for i in range(1, len(seeds)):
                tree, gone = T.influence_tree(into, v, 0.05, set(seeds[:i]), barred), set()
                for s in seeds[:i]:
                    way = [s]
                    while way[-1] in tree and way[-1] != v:
                        way.append(tree[way[-1]][0])
                    gone |= {s} if s in tree and seeds[i] in way else set()
                barred |= gone
            out.append(T.tree_state(T.influence_tree(into, v, 0.05, set(seeds), barred), v, set(seeds)))
        return out

    dags = lambda seeds: [T.dag_state(T.local_dag(into, v, 1 / 40), v, set(seeds)) for v in nodes]
    got = T.pmia(weighted, 5, 0.05) if name == "pmia" else T.ldag(weighted, 5, 1 / 40)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == plain_greedy(trees if name == "pmia" else dags, nodes, 5)


@pytest.mark.parametrize("name", ["pmia", "ldag"])
def test_long_structures_take_few_rounds(spark, monkeypatch, name):
    """A chain of 30 nodes: its lists come in about log2(30) rounds, not 30, and all of them."""
    asked, by_root = [], T._by_root
    monkeypatch.setattr(T, "_by_root", lambda *a: asked.append(1) or by_root(*a))
    chain = M.uniform_weights(edges(spark, [(v, v + 1, 1) for v in range(29)])).withColumn("p", F.lit(0.99))
    if name == "pmia":
        got = T.pmia(chain, 1, 0.05)
        want = sum(0.99**v for v in range(30))
    else:
        got, want = T.ldag(chain, 1), 30.0
    assert [tuple(r) for r in got.collect()] == [(1, 0, pytest.approx(want, abs=1e-8))]
    assert len(asked) <= 9


def test_threshold_spreads_follow_only_what_is_added(monkeypatch):
    rng = np.random.default_rng(12)
    for _ in range(20):
        pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 10, 30), rng.integers(0, 10, 30))})
        g = kernels.Arcs(*np.array(pairs).T, rng.integers(1, 400, len(pairs)))
        need, held = rng.integers(1, 700, g.n), np.arange(min(2, g.n))
        src = np.repeat(np.arange(g.n), np.diff(g.start))

        def plain(seeds):
            on = np.isin(np.arange(g.n), seeds)
            while (more := ~on & (np.bincount(g.to, g.extra * on[src], g.n) >= need)).any():
                on |= more
            return on.sum()

        want = [plain([*held, v]) for v in range(g.n)]
        for cells in (1, 1 << 21):
            assert kernels.threshold_spreads(g, need, held, np.arange(g.n), cells).tolist() == want
    path, followed = kernels.Arcs(np.arange(500), np.arange(1, 501), np.ones(500, np.int64)), []
    note = kernels.activate
    monkeypatch.setattr(kernels, "activate", lambda g, lack, lit, front, **most: followed.append(-int(lack.sum())) or note(g, lack, lit, front, **most) or followed.append(int(lack.sum())))
    assert kernels.threshold_spreads(path, np.ones(501, np.int64), np.array([400]), np.arange(501)).tolist() == [501 - v if v < 400 else 101 for v in range(501)]
    assert -sum(followed) == 100 + 400 * 401 // 2  # arcs: those of held once, and what each tried one adds


def test_nested_spreads_equal_those_followed_one_by_one(monkeypatch):
    rng = np.random.default_rng(13)
    for _ in range(60):
        n = int(rng.integers(5, 40))
        pairs = np.unique(rng.integers(0, n, (4 * n, 2)), axis=0)
        g = kernels.Arcs(*pairs.T, rng.integers(1, 400, len(pairs)))
        need, held = rng.integers(1, rng.integers(200, 1200), g.n), rng.choice(g.n, rng.integers(0, 3), replace=False)
        tried = rng.permutation(g.n)[: rng.integers(1, g.n + 1)]
        want = kernels.threshold_spreads(g, need, held, tried).tolist()
        for some, cells in ((0, 1), (1, 100), (3, 1 << 20), (512, 200)):
            assert kernels.nested_spreads(g, need, held, tried, some, cells).tolist() == want
    path, arcs = kernels.Arcs(np.arange(500), np.arange(1, 501), np.ones(500, np.int64)), []
    note = kernels.follow
    monkeypatch.setattr(kernels, "follow", lambda *a, **b: arcs.append(len((got := note(*a, **b))[0])) or got)
    assert kernels.nested_spreads(path, np.ones(501, np.int64), np.array([], int), np.arange(501), 10).tolist() == list(range(501, 0, -1))
    assert sum(arcs) < 25 * 500  # one by one: 125,250

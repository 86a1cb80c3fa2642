"""Operators that run as kernels on worlds of a task's size: their join forms give the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplekit.operators import diffusion as D
from ripplekit.operators import models as M
from ripplekit.operators import reliability as R
from ripplekit.operators import selection as K
from ripplekit.operators import sparsify as X
from ripplekit.operators import worlds as W


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def live(spark):
    rng = np.random.default_rng(5)
    arcs = [(int(w), int(a), int(b)) for w, a, b in zip(rng.integers(0, 2, 40), rng.integers(0, 15, 40), rng.integers(0, 15, 40))]
    ring = [(2, i, (i + 1) % 6) for i in range(6)] + [(2, i, i + 1) for i in range(10, 16)] + [(2, 3, 10), (2, 20, 20)]
    return spark.createDataFrame(arcs + ring, "world int, src long, dst long")


@pytest.fixture(scope="module")
def arcs(spark):
    rng = np.random.default_rng(6)
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 25, 90), rng.integers(0, 25, 90)) if a != b})
    return spark.createDataFrame([(a, b, 1 + (a + b) % 3) for a, b in pairs], "src long, dst long, w long")


@pytest.mark.parametrize("undirected", [False, True])
def test_first_seed_rank(spark, live, undirected):
    seeds = spark.createDataFrame([(1, 4), (2, 9), (3, 2), (4, 99)], "rank int, node long")
    got = W.first_seed_rank(live, seeds, 3, undirected, kernel=False)
    assert rows(got) == rows(W.first_seed_rank(live, seeds, 3, undirected, kernel=True))


def test_strong_components(live):
    assert rows(W.strong_components(live, kernel=False)) == rows(W.strong_components(live, kernel=True))


def test_strong_components_of_no_arcs(live):
    assert rows(W.strong_components(live.where("world > 9"), kernel=False)) == []


def test_reach(live):
    assert rows(W.reach_pairs(live, kernel=False)) == rows(W.reach_pairs(live, kernel=True))
    for method in ("topsort", "bfs"):
        assert rows(W.reach_sizes(live, method, kernel=False)) == rows(W.reach_sizes(live, method, kernel=True))


def test_selection_and_spread_of_larger_worlds(spark, arcs, monkeypatch):
    sets = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 99)], "set string, node long")
    seeds = K.top_degree(arcs, 4)
    make = {
        "sets": lambda: D.spread_of_sets(arcs, sets, 6, 0.3),
        "curve": lambda: D.spread_curve(arcs, seeds, 6, 0.3),
        "greedy": lambda: K.general_greedy(arcs, 3, 6, 0.3),
        "new greedy": lambda: K.new_greedy(arcs, arcs.select(F.col("src").alias("node")).distinct(), 3, 6, 0.3),
    }
    want = {name: rows(f()) for name, f in make.items()}
    monkeypatch.setattr(W, "KERNEL_EDGES", 0)
    assert {name: rows(f()) for name, f in make.items()} == want


def test_forests(spark):
    rng = np.random.default_rng(7)
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in zip(rng.integers(0, 20, 60), rng.integers(0, 20, 60)) if a != b})
    edges = spark.createDataFrame([(a, b, 0.1 * (1 + (a * b) % 7)) for a, b in [*pairs, (50, 51)]], X.EDGE)
    assert rows(R.forest_by_rounds(edges)) == rows(R.spanning_forest(edges))
    assert rows(R.peel_by_rounds(edges)) == rows(R.forests(edges))
    assert rows(R.peel_by_rounds(edges.limit(0))) == []


def plain_greedy(score, nodes, k):
    taken = []
    while len(taken) < min(k, len(nodes)):
        held = [n for n, _ in taken]
        best = min((-round(score(n, held), 9), n) for n in nodes if n not in held)
        taken.append((best[1], -best[0]))
    return taken


def test_discounts_equal_a_plain_recount(arcs):
    w = {(r["src"], r["dst"]): r["w"] for r in arcs.collect()}
    nodes = sorted({a for a, _ in w})
    d = {n: sum(x for (a, _), x in w.items() if a == n) for n in nodes}
    t = lambda n, held: sum(w.get((s, n), 0) for s in held)
    fire = lambda x: 1 - 0.8**x
    gone = {n: sum(fire(x) for (a, _), x in w.items() if a == n) for n in nodes}

    def general(n, held):
        hit = [w[s, n] for s in held if (s, n) in w]
        return 0.8 ** sum(hit) * (1 + gone[n] - sum(map(fire, hit)))

    want = {
        "single": (K.single_discount(arcs, 6), lambda n, h: d[n] - t(n, h)),
        "degree": (K.degree_discount(arcs, 6, 0.1), lambda n, h: d[n] - 2 * t(n, h) - (d[n] - t(n, h)) * t(n, h) * 0.1),
        "star": (K.degree_discount_star(arcs, 6, 0.1), lambda n, h: 0.9 ** t(n, h) * (1 + (d[n] - t(n, h)) * 0.1)),
        "general": (K.general_discount(arcs.withColumn("p", F.lit(0.2)), 6), general),
        "penalized": (K.penalized(K.degrees(arcs), arcs, 6, 0.1, 0.5), lambda n, h: d[n] * 0.9 ** (0.5 * t(n, h))),
    }
    for name, (got, score) in want.items():
        found = [(r["node"], round(r["score"], 6)) for r in got.orderBy("rank").collect()]
        assert found == [(n, round(s, 6)) for n, s in plain_greedy(score, nodes, 6)], name


def test_degree_loss_equals_a_plain_search(spark):
    rng = np.random.default_rng(8)
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in zip(rng.integers(0, 12, 60), rng.integers(0, 12, 60)) if a != b})
    edges = [(a, b, round(0.15 + 0.1 * ((a + 2 * b) % 8), 2)) for a, b in pairs]
    missing = dict.fromkeys({n for e in edges for n in e[:2]}, 0.0)
    for a, b, p in edges:
        missing[a] += p
        missing[b] += p
    left, want = {e[:2] for e in edges}, []
    for _ in range(20):
        lost = {e: min((abs(missing[e[0]]) + abs(missing[e[1]])) / 2, 1.0) for e in left}
        e = max(left, key=lambda e: (round(lost[e], 12), e))
        left.discard(e)
        want.append((*e, round(lost[e], 9)))
        missing[e[0]] -= lost[e]
        missing[e[1]] -= lost[e]
    got = X.greedy_degree_loss(spark.createDataFrame(edges, X.EDGE), 20)
    assert sorted((r["src"], r["dst"], round(r["p"], 9)) for r in got.collect()) == sorted(want)


def test_linear_threshold_greedy_equals_a_plain_search(spark):
    rng = np.random.default_rng(9)
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 9, 26), rng.integers(0, 9, 26)) if a != b})
    weighted = M.uniform_weights(spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, w long"))
    b = {(r["src"], r["dst"]): r["b"] * r["w"] for r in weighted.collect()}
    nodes = sorted({n for e in pairs for n in e})
    theta = {(r["world"], r["node"]): r["threshold"] for r in D.thresholds(spark.createDataFrame([(n,) for n in nodes], "node long"), 4).collect()}

    def spread(seeds):
        total = 0
        for world in range(4):
            on = set(seeds)
            while True:
                pull = {n: sum(x for (s, d), x in b.items() if d == n and s in on) for n in nodes if n not in on}
                more = {n for n, x in pull.items() if x > 0 and round(x, 9) >= theta[world, n]}
                if not more:
                    break
                on |= more
            total += len(on)
        return total / 4

    want: list[tuple[int, float]] = []
    for _ in range(3):
        held = [n for n, _ in want]
        score, node = min((-spread([*held, n]), n) for n in nodes if n not in held)
        want.append((node, -score))
    assert [(r["node"], r["score"]) for r in K.general_greedy_lt(weighted, 3, 4).orderBy("rank").collect()] == want


def test_linear_threshold_greedy_leaves_the_graph_to_the_tasks(spark, arcs, monkeypatch):
    weighted = M.uniform_weights(arcs)
    want = [tuple(r) for r in K.general_greedy_lt(weighted, 3, 4).orderBy("rank").collect()]
    one = [D.linear_threshold(weighted, spark.createDataFrame([(n,) for _, n, _ in want[:k]], "node long"), 4).count() / 4 for k in (1, 2, 3)]
    assert [score for _, _, score in want] == one

    def refused(*_, **__):
        raise AssertionError("the graph goes to the driver")

    monkeypatch.setattr(type(arcs), "toPandas", refused)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    monkeypatch.setattr(K, "BLOCK_NODES", 4)
    monkeypatch.setattr(K, "PIECE_ARCS", 3)
    weighted = weighted.unionByName(weighted.limit(1).selectExpr("src", "cast(null as bigint) dst", "w", "b"))
    assert [tuple(r) for r in K.general_greedy_lt(weighted, 3, 4).orderBy("rank").collect()] == want
    assert len(K.general_greedy_lt(weighted.where("src in (1, 2) and dst in (1, 2)"), 9, 2).collect()) <= 2
    assert K.general_greedy_lt(weighted.limit(0), 3, 4).collect() == []


def test_directed_harvest_equals_a_plain_scan(live):
    want: dict[int, float] = {}
    for world in range(3):
        out: dict[int, set] = {}
        for r in live.where(F.col("world") == world).collect():
            out.setdefault(r["src"], set()).add(r["dst"])
            out.setdefault(r["dst"], set())
        reach = {}
        for v in out:
            seen, todo = set(), [v]
            while todo:
                for u in out[todo.pop()] - seen:
                    seen.add(u)
                    todo.append(u)
            reach[v] = seen - {v}
        into = {v: sum(v in s for s in reach.values()) for v in out}
        order = sorted(out, key=lambda v: (-len(reach[v]), v))
        covered, free, last = set(), [], None
        for v in order:
            if len(free) >= 2 and len(reach[v]) != last:
                break
            want[v] = want.get(v, 0) + sum(1 / into[x] for x in reach[v])
            if len(free) < 2:
                last = len(reach[v])
                if v not in covered:
                    free.append(v)
                    covered |= reach[v] | {v}
    got = {r["node"]: r["score"] for r in K.directed_harvest_scores(live, 2).collect()}
    assert got == pytest.approx(want)

"""Sparsification of uncertain graphs (src < dst, p), and representative worlds.

Top-k and join forms stay in DataFrames. Steps that are sequential by nature (pruning, rewiring,
greedy matching) run as one executor task, on graphs of a bounded size; their coins are hashes.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..schema import SEED, u01
from . import reliability as R

EDGE = "src long, dst long, p double"


def coin(*parts) -> float:
    """The driver-side twin of ``schema.u01``."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


def top_probable(edges: DataFrame, k: int) -> DataFrame:
    return edges.select("src", "dst", "p").orderBy(F.desc("p"), "src", "dst").limit(k)


def random_edges(edges: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    return edges.select("src", "dst", "p").orderBy(u01(seed, "edge", F.col("src"), F.col("dst")), "src", "dst").limit(k)


def forest_order(edges: DataFrame, k: int) -> DataFrame:
    """Whole forests as they are peeled off, and of the last one the most probable edges: k in all."""
    return R.forests(edges).orderBy("tree", F.desc("p"), "src", "dst").limit(k).select("src", "dst", "p")


def coin_rounds(edges: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """Edges by p, over and over, each kept with chance p, until there are k.

    The round of an edge's first success is geometric and drawn at once, so the k first are a sort.
    """
    u = u01(seed, "round", F.col("src"), F.col("dst"))
    turn = F.when(F.col("p") >= 1, F.lit(0.0)).otherwise(F.floor(F.log(1 - u) / F.log(1 - F.col("p"))))
    return edges.where("p > 0").withColumn("turn", turn).orderBy("turn", F.desc("p"), "src", "dst").limit(k).select("src", "dst", "p")


def relevance(edges: DataFrame, rel: DataFrame, k: int, descending: bool = True, digits: int = 9) -> DataFrame:
    """k edges by p (1 - r) / (1 - p), where r is the reliability of the edge's own ends (missing: 0); p = 1 is infinite."""
    joined = edges.join(rel.select(F.col("u").alias("src"), F.col("v").alias("dst"), "r"), ["src", "dst"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    score = F.when(F.col("p") >= 1, F.lit(float("inf"))).otherwise(F.round(F.col("p") * (1 - F.col("r")) / (1 - F.col("p")), digits))
    scored = joined.withColumn("score", score)
    return scored.orderBy(F.desc("score") if descending else F.asc("score"), "src", "dst").limit(k).select("src", "dst", "p", "score")


def path_counts(edges: DataFrame, cutoff: float = math.inf) -> DataFrame:
    """(src, dst, paths): shortest paths (by -ln p, one per pair) that use each edge."""
    rows = R.local(edges)
    shared = edges.sparkSession.sparkContext.broadcast(kernels.neighbours((u, v, -math.log(p)) for u, v, p in rows if p > 0))
    roots = edges.select(F.explode(F.array("src", "dst")).alias("root")).distinct().repartition(edges.sparkSession.sparkContext.defaultParallelism)

    def run(it):
        for pdf in it:
            uses: dict[tuple[int, int], int] = {}
            for root in pdf["root"]:
                cost, parent = kernels.shortest_paths(shared.value, root, cutoff)
                for v in cost:
                    if v > root:
                        while v != root:
                            e = (min(v, parent[v]), max(v, parent[v]))
                            uses[e] = uses.get(e, 0) + 1
                            v = parent[v]
            yield pd.DataFrame([(a, b, n) for (a, b), n in uses.items()], columns=["src", "dst", "paths"])

    return roots.mapInPandas(run, "src long, dst long, paths long").groupBy("src", "dst").agg(F.sum("paths").alias("paths"))


def shortest_path_edges(edges: DataFrame, k: int, cutoff: float = math.inf) -> DataFrame:
    """k edges by p times the shortest paths over them; an edge on none counts 0."""
    scored = edges.join(path_counts(edges, cutoff), ["src", "dst"], "left").withColumn("score", F.round(F.col("p") * F.coalesce("paths", F.lit(0)), 9))
    return scored.orderBy(F.desc("score"), "src", "dst").limit(k).select("src", "dst", "p")


def _fill_up(rows: list, forest: list, k: int) -> list:
    held = {(u, v) for u, v, _ in forest}
    rest = sorted((e for e in rows if (e[0], e[1]) not in held), key=lambda e: (-e[2], e[0], e[1]))
    return forest + rest[: k - len(forest)]


def prune_leaves(forest: list[tuple[int, int, float]], k: int) -> list[tuple[int, int, float]]:
    """Drop the least probable edge at a leaf until k are left; new leaves join."""
    adj = kernels.neighbours(forest)
    heap = [(x, min(u, v), max(u, v)) for u in adj if len(adj[u]) == 1 for v, x in adj[u].items()]
    heapq.heapify(heap)
    left = len(forest)
    while left > k and heap:
        _, u, v = heapq.heappop(heap)
        if v not in adj[u]:
            continue
        del adj[u][v], adj[v][u]
        left -= 1
        for a in (u, v):
            if len(adj[a]) == 1:
                ((b, x),) = adj[a].items()
                heapq.heappush(heap, (x, min(a, b), max(a, b)))
    return [(u, v, x) for u, v, x in forest if v in adj[u]]


def prune_power(forest: list[tuple[int, int, float]], k: int) -> list[tuple[int, int, float]]:
    """Drop the edge with the most neighbouring edges until k are left: inner edges first, then those that
    had a leaf at the start. Neighbour counts fall as edges go; ties go to the smaller edge."""
    adj = {u: set(vs) for u, vs in kernels.neighbours(forest).items()}
    outer = {(u, v): len(adj[u]) == 1 or len(adj[v]) == 1 for u, v, _ in forest}
    power = {(u, v): len(adj[u]) + len(adj[v]) - 2 for u, v, _ in forest}
    heap = [(outer[e], -n, e) for e, n in power.items()]
    heapq.heapify(heap)
    while len(power) > k:
        _, n, e = heapq.heappop(heap)
        if power.get(e) != -n:
            continue
        del power[e]
        adj[e[0]].discard(e[1])
        adj[e[1]].discard(e[0])
        for a in e:
            for b in adj[a]:
                f = (min(a, b), max(a, b))
                power[f] -= 1
                heapq.heappush(heap, (outer[f], -power[f], f))
    return [x for x in forest if (x[0], x[1]) in power]


def forest_plus(edges: DataFrame, k: int, prune: str = "leaves") -> DataFrame:
    """The most probable spanning forest with the next most probable edges, or pruned down, to k edges."""
    cut = {"leaves": prune_leaves, "power": prune_power}[prune]

    def run(rows):
        forest = R._forest(rows)
        return _fill_up(rows, forest, k) if len(forest) <= k else cut(forest, k)

    return R.on_one_task(edges, run, EDGE)


def greedy_degree_loss(edges: DataFrame, k: int) -> DataFrame:
    """k edges, each the one whose ends miss most of their expected degree; its p becomes half that loss, 1 at most.

    Ties take the last edge. Taking an edge changes the losses at its two ends only: these go into the
    heap again, and entries of old values are passed over.
    """

    def run(rows):
        want: dict[int, float] = {}
        for u, v, p in rows:
            want[u], want[v] = want.get(u, 0.0) + p, want.get(v, 0.0) + p
        now = dict.fromkeys(want, 0.0)
        loss = lambda u, v: min((abs(want[u] - now[u]) + abs(want[v] - now[v])) / 2, 1.0)
        value = lambda e: round(loss(*e), 12)
        left, out, at = {(u, v) for u, v, _ in rows}, [], {}
        for u, v in left:
            at.setdefault(u, set()).add((u, v))
            at.setdefault(v, set()).add((u, v))
        heap = [(-value(e), -e[0], -e[1]) for e in left]
        heapq.heapify(heap)
        while heap and len(out) < k:
            low, u, v = heapq.heappop(heap)
            best = (-u, -v)
            if best not in left or -low != value(best):
                continue
            x = loss(*best)
            left.discard(best)
            out.append((*best, x))
            for end in best:
                now[end] += x
                at[end].discard(best)
            for e in at[best[0]] | at[best[1]]:
                heapq.heappush(heap, (-value(e), -e[0], -e[1]))
        return out

    return R.on_one_task(edges, run, EDGE)


# --- degrees -------------------------------------------------------------------------------------


def expected_degrees(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(node, d) of undirected edges, or (node, dout, din) of arcs."""
    if not directed:
        return edges.select(F.explode(F.array("src", "dst")).alias("node"), "p").groupBy("node").agg(F.sum("p").alias("d"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("p").alias("o"), F.lit(0.0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0.0).alias("o"), F.col("p").alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("o").alias("dout"), F.sum("i").alias("din"))


def chung_lu(edges: DataFrame) -> DataFrame:
    """(u, v, p), u <= v, for all pairs: d(u) d(v) / sum d, half of that for u = v. For small graphs."""
    d = expected_degrees(edges)
    total = d.agg(F.sum("d").alias("W"))
    a, b = d.select(F.col("node").alias("u"), F.col("d").alias("du")), d.select(F.col("node").alias("v"), F.col("d").alias("dv"))
    pairs = a.join(b, F.col("u") <= F.col("v")).crossJoin(F.broadcast(total))  # one row
    return pairs.select("u", "v", (F.col("du") * F.col("dv") / F.col("W") / F.when(F.col("u") == F.col("v"), 2).otherwise(1)).alias("p"))


def reassign_chung_lu(arcs: DataFrame, out_degrees: DataFrame, side: str = "src") -> DataFrame:
    """Arcs with p shared out by the wanted degree (node, d) of one end, in proportion to the other end's; 1 at most."""
    other = "dst" if side == "src" else "src"
    mine, theirs = out_degrees.select(F.col("node").alias(side), F.col("d").alias("mine")), out_degrees.select(F.col("node").alias(other), F.col("d").alias("theirs"))
    rows = arcs.select("src", "dst").join(mine, side).join(theirs, other)
    share = F.col("mine") * F.col("theirs") / F.sum("theirs").over(Window.partitionBy(side))
    return rows.select("src", "dst", F.least(share, F.lit(1.0)).alias("p"))


def reassign_equally(arcs: DataFrame, degrees: DataFrame, side: str = "src") -> DataFrame:
    """Arcs with p = min(d / number of the node's arcs, 1)."""
    rows = arcs.select("src", "dst").join(degrees.select(F.col("node").alias(side), "d"), side)
    return rows.select("src", "dst", F.least(F.col("d") / F.count("*").over(Window.partitionBy(side)), F.lit(1.0)).alias("p"))


def redistribute(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Kept edges with the probability of the removed ones: half of it goes to each end, and is shared
    equally by the end's kept edges; 1 at most."""
    kept = edges.join(selected.select("src", "dst"), ["src", "dst"], "left_semi")
    gone = edges.join(selected.select("src", "dst"), ["src", "dst"], "left_anti")
    extra = gone.select(F.explode(F.array("src", "dst")).alias("node"), (F.col("p") / 2).alias("x")).groupBy("node").agg(F.sum("x").alias("x"))
    count = kept.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    share = count.join(extra, "node").select("node", (F.col("x") / F.col("n")).alias("add"))
    rows = kept
    for end in ("src", "dst"):
        rows = rows.join(share.select(F.col("node").alias(end), F.col("add").alias(f"add_{end}")), end, "left")
    return rows.select("src", "dst", F.least(F.col("p") + F.coalesce("add_src", F.lit(0.0)) + F.coalesce("add_dst", F.lit(0.0)), F.lit(1.0)).alias("p"))


def degree_error(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """(mae): the mean absolute gap between wanted degrees (node, d) and those of edges (src, dst, p)."""
    now = expected_degrees(edges).select("node", F.col("d").alias("have"))
    both = degrees.join(now, "node", "full_outer")
    return both.agg(F.avg(F.abs(F.coalesce("d", F.lit(0.0)) - F.coalesce("have", F.lit(0.0)))).alias("mae"))


def fill_degrees(edges: DataFrame, degrees: DataFrame, rounds: int = 400) -> DataFrame:
    """The linear program max sum x, A x <= d, 0 <= x <= 1 on edges (src, dst): (src, dst, p).

    Solved by a multiplicative dual (prices on nodes, mirrored on edges) whose mean is scaled down to a
    feasible point and then filled up edge by edge; sequential, in one task.
    """
    want = {r["node"]: float(r["d"]) for r in degrees.collect()}

    def run(rows):
        e = np.array([(u, v) for u, v, _ in rows], np.int64).reshape(-1, 2)
        nodes, at = np.unique(e, return_inverse=True)
        a, b = at.reshape(-1, 2).T if len(e) else (np.zeros(0, int),) * 2
        d = np.array([want.get(int(n), 0.0) for n in nodes])
        price, mean = np.zeros(len(nodes)), np.zeros(len(e))
        for t in range(1, rounds + 1):
            x = np.clip((1 - price[a] - price[b]) * 2, 0, 1)
            use = np.bincount(a, x, len(nodes)) + np.bincount(b, x, len(nodes))
            price = np.maximum(price + 0.5 / math.sqrt(t) * (use - d) / np.maximum(d, 1), 0)
            mean += x
        mean /= rounds
        use = np.bincount(a, mean, len(nodes)) + np.bincount(b, mean, len(nodes))
        scale = np.minimum(1, d / np.maximum(use, 1e-12))
        x = mean * np.minimum(scale[a], scale[b])
        room = d - np.bincount(a, x, len(nodes)) - np.bincount(b, x, len(nodes))
        for i in range(len(e)):
            more = max(0.0, min(1 - x[i], room[a[i]], room[b[i]]))
            x[i] += more
            room[a[i]] -= more
            room[b[i]] -= more
        return [(int(u), int(v), float(y)) for (u, v), y in zip(e, x)]

    return R.on_one_task(edges.withColumn("p", F.lit(0.0)) if "p" not in edges.columns else edges, run, EDGE)


# --- representative worlds -----------------------------------------------------------------------


def _expected(rows) -> dict[int, float]:
    out: dict[int, float] = {}
    for u, v, p in rows:
        out[u], out[v] = out.get(u, 0.0) + p, out.get(v, 0.0) + p
    return out


def _by_probability(rows):
    return sorted(rows, key=lambda e: (-e[2], e[0], e[1]))


def greedy_world(edges: DataFrame) -> DataFrame:
    """Edges by p, each taken if that lowers the summed discrepancy of its ends from expected degrees.

    Changes are rounded to 9 digits, so that summation order can't decide where the sum stays the same.
    """

    def run(rows):
        gap, out = {n: -x for n, x in _expected(rows).items()}, []
        for u, v, p in _by_probability(rows):
            if round(abs(gap[u] + 1) + abs(gap[v] + 1) - abs(gap[u]) - abs(gap[v]), 9) < 0:
                gap[u] += 1
                gap[v] += 1
                out.append((u, v, p))
        return out

    return R.on_one_task(edges, run, EDGE)


def _coin_cycle(order: list, total: float, strict: bool, tag: str, seed: int) -> list:
    """Edges in order, again and again, each taken with its chance, until ``total`` (strict: more) are."""
    taken, turn = [], 0
    left = [e for e in order if e[2] > 0]
    while left and (len(taken) <= total if strict else len(taken) < total):
        rest = []
        for i, e in enumerate(left):
            if (len(taken) > total) if strict else (len(taken) >= total):
                rest += left[i:]
                break
            if coin(seed, tag, turn, e[0], e[1]) < e[2]:
                taken.append(e)
            else:
                rest.append(e)
        left, turn = rest, turn + 1
    return taken


def rewired_world(edges: DataFrame, steps: int = 10, seed: int = SEED) -> DataFrame:
    """round(sum p) edges by coins in order of p, then ``steps`` sweeps over nodes that swap a live edge of the
    node for a blocked edge, both by hash, if the summed discrepancy falls."""

    def run(rows):
        live = set(_coin_cycle(_by_probability(rows), round(sum(p for _, _, p in rows)), False, "rewire", seed))
        gap = {n: -x for n, x in _expected(rows).items()}
        for u, v, _ in live:
            gap[u] += 1
            gap[v] += 1
        at: dict[int, list] = {n: [] for n in gap}
        for e in sorted(live):
            at[e[0]].append(e)
            at[e[1]].append(e)
        blocked = [e for e in rows if e not in live]
        for step in range(steps):
            for node in sorted(gap):
                if not at[node] or not blocked:
                    continue
                off = at[node][int(coin(seed, "live", step, node) * len(at[node]))]
                i = int(coin(seed, "blocked", step, node) * len(blocked))
                on, before = blocked[i], dict(gap)
                for e, d in ((off, -1), (on, 1)):
                    gap[e[0]] += d
                    gap[e[1]] += d
                ends = {*off[:2], *on[:2]}
                if round(sum(abs(gap[n]) - abs(before[n]) for n in ends), 9) < 0:
                    blocked[i] = off
                    for n in off[:2]:
                        at[n].remove(off)
                    for n in on[:2]:
                        at[n].append(on)
                else:
                    gap = before
        return sorted({e for es in at.values() for e in es})

    return R.on_one_task(edges, run, EDGE)


def matched_world(edges: DataFrame, seed: int = SEED) -> DataFrame:
    """A maximal b-matching, b the rounded expected degree, in hash order; then edges from nodes that lack more
    than half an edge (A) to those that lack less (B), greedily by gain, each B once."""

    def run(rows):
        want = _expected(rows)
        degree, out = dict.fromkeys(want, 0), []
        for u, v, p in sorted(rows, key=lambda e: (coin(seed, "match", e[0], e[1]), e)):
            if degree[u] < round(want[u]) and degree[v] < round(want[v]):
                degree[u] += 1
                degree[v] += 1
                out.append((u, v, p))
        gap, held = {n: degree[n] - want[n] for n in want}, {(u, v) for u, v, _ in out}
        gain = lambda a, b: abs(gap[a]) + 2 * abs(gap[b]) - abs(1 + gap[a]) - 1
        pairs = []
        for u, v, p in rows:
            for a, b in ((u, v), (v, u)):
                if (u, v) not in held and gap[a] < -0.5 < gap[b] < 0 and gain(a, b) > 0:
                    pairs.append((-gain(a, b), a, b, (u, v, p)))
        heapq.heapify(pairs)
        used: set[int] = set()
        while pairs:
            g, a, b, e = heapq.heappop(pairs)
            if b in used or gap[a] >= -0.5:
                continue
            if gain(a, b) != -g:
                if gain(a, b) > 0:
                    heapq.heappush(pairs, (-gain(a, b), a, b, e))
                continue
            used.add(b)
            gap[a] += 1
            gap[b] += 1
            out.append(e)
        return out

    return R.on_one_task(edges, run, EDGE)


def forest_world(edges: DataFrame, seed: int = SEED) -> DataFrame:
    """Edges of the peeled forests in order (by p in each), taken by coins until more than sum p are."""

    def run(rows):
        order = [e for f in R.peeled_forests(rows) for e in _by_probability(f)]
        return _coin_cycle(order, sum(p for _, _, p in rows), True, "forest", seed)

    return R.on_one_task(edges, run, EDGE)

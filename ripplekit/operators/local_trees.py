"""Seed selection on local structures: maximum-influence trees and local DAGs, one per root.

A root's structure is made by a kernel from the arcs into its nodes. These are fetched by joins: in a
round every root asks for the lists of the nodes that its structure has gained and for what these nodes have
gained themselves, until none gains any, so no task holds more of the graph than a root's own neighbourhood. The state (root, node, alpha, ap, gain)
of all roots is one table, from which a step's best node is an aggregate. After a pick only the roots
whose structure holds the picked node are made again.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, store

STATE = "root long, node long, alpha double, ap double, gain double"
LISTS = "root long, head long, tails array<long>, xs array<double>"


def _by_root(lists: DataFrame, kernel: Callable[[int, dict], list[tuple]], schema: str) -> DataFrame:
    """The rows of kernel(root, {head: [(tail, x)]}) for each root of lists, one root in memory at a time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(it):
        root, into = None, {}
        for pdf in it:
            out = []
            for r, head, tails, xs in zip(pdf["root"].tolist(), pdf["head"].tolist(), pdf["tails"], pdf["xs"]):
                if r != root:
                    out += kernel(root, into) if into else []
                    root, into = r, {}
                into[head] = list(zip(tails.tolist(), xs.tolist()))
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(kernel(root, into) if into else [], columns=names)

    return lists.repartition("root").sortWithinPartitions("root").mapInPandas(run, schema)


def _neighbourhoods(arcs: DataFrame, value: str, members: Callable[[int, dict], dict[int, float]], theta: float, above: float = 0.0) -> DataFrame:
    """LISTS: for every root the arcs, of values above ``above``, into each of members(root, its lists).

    members tells each node's influence on the root. With a node's list come the lists of what that node's own
    structure holds so far and may matter here by theta, so the reach of a round doubles: a long structure
    takes about the logarithm of its steps in rounds. What comes too much changes no result.
    """
    pairs = arcs.where("src <> dst").select("src", "dst", F.col(value).alias("x")).where(F.col("x") > above)
    packed = pairs.groupBy(F.col("dst").alias("head")).agg(F.array_sort(F.collect_list(F.struct("src", "x"))).alias("a"))
    lists = store(packed.select("head", F.col("a.src").alias("tails"), F.col("a.x").alias("xs")), "lists")
    have = store(arcs.select(F.explode(F.array("src", "dst")).alias("root")).distinct().withColumn("head", F.col("root")), "have")

    def filled(which: DataFrame) -> DataFrame:
        kinds = (("tails", "array<bigint>"), ("xs", "array<double>"))
        return which.join(lists, "head", "left").select("root", "head", *[F.coalesce(F.col(c), F.array().cast(kind)).alias(c) for c, kind in kinds])

    def found(root: int, into: dict) -> list[tuple[int, int, float, bool]]:
        return [(root, x, v, x not in into) for x, v in members(root, into).items()]

    structures, open_roots = None, None
    while True:
        which = have if open_roots is None else have.join(open_roots, "root", "left_semi")
        new = _by_root(filled(which), found, "root long, node long, value double, fresh boolean")
        kept = [] if open_roots is None else [structures.join(open_roots, "root", "left_anti")]
        old, structures = structures, store(reduce(DataFrame.unionByName, kept, new), "structures")
        if old is not None:
            drop(old)
        wanted = structures.where("fresh")
        if wanted.isEmpty():
            out = store(filled(have), "local")
            for t in (structures, have, lists):
                drop(t)
            return out
        further = structures.select(F.col("root").alias("by"), F.col("node").alias("head"), F.col("value").alias("more"))
        near = wanted.join(further, wanted["node"] == further["by"]).where(F.col("value") * F.col("more") >= theta * (1 - 1e-9)).select("root", "head")
        before, have = have, store(have.unionByName(wanted.select("root", F.col("node").alias("head"))).unionByName(near).distinct(), "have")
        drop(before)
        open_roots = wanted.select("root").distinct()


def influence_tree(into: dict, root: int, theta: float, seeds: set[int], barred: set[int]) -> dict[int, tuple[int, float, int]]:
    """node -> (next node toward the root, p of that arc, steps), for paths of probability above theta.

    Nearest first, ties by (tail, head); paths don't go on behind a seed, and barred nodes are left out.
    """
    limit, heap, out = -math.log(theta), [(0.0, root, root, 1.0, 0)], {}
    while heap:
        cost, node, toward, p, steps = heapq.heappop(heap)
        if node in out:
            continue
        out[node] = (toward, p, steps)
        if node in seeds and node != root:
            continue
        for tail, q in into.get(node, ()):
            if tail not in out and tail not in barred and q > 0 and cost - math.log(q) < limit:
                heapq.heappush(heap, (cost - math.log(q), tail, node, q, steps + 1))
    return out


def path_values(tree: dict[int, tuple[int, float, int]]) -> dict[int, float]:
    """The probability of the path of every node of a tree to its root, which comes first."""
    out: dict[int, float] = {}
    for node, (toward, p, _) in tree.items():
        out[node] = out.get(toward, 1.0) * p
    return out


def tree_state(tree: dict, root: int, seeds: set[int]) -> list[tuple[int, int, float, float, float]]:
    """Activation probabilities from the leaves, linear coefficients from the root, and gains."""
    below: dict[int, list[int]] = {}
    for node, (toward, _, _) in tree.items():
        if node != root:
            below.setdefault(toward, []).append(node)
    ap, alpha = {}, {root: 1.0}
    for node in sorted(tree, key=lambda n: (-tree[n][2], n)):
        miss = math.prod(1 - ap[c] * tree[c][1] for c in below.get(node, ()))
        ap[node] = 1.0 if node in seeds else 1 - miss
    for node in sorted(tree, key=lambda n: (tree[n][2], n)):
        for child in below.get(node, ()):
            others = math.prod(1 - ap[c] * tree[c][1] for c in below[node] if c != child)
            alpha[child] = 0.0 if node in seeds else alpha[node] * tree[child][1] * others
    return [(root, n, alpha[n], ap[n], 0.0 if n in seeds else alpha[n] * (1 - ap[n])) for n in sorted(tree)]


def _best(state: DataFrame, seeds: list[int]) -> tuple[int, float] | None:
    gains = state.groupBy("node").agg(F.round(F.sum("gain"), 9).alias("g"))
    chosen = state.sparkSession.createDataFrame([(s,) for s in seeds] or [(-1,)], "node long")
    got = gains.join(F.broadcast(chosen), "node", "left_anti").orderBy(F.desc("g"), "node").limit(1).collect()
    return (got[0]["node"], got[0]["g"]) if got else None


def pmia_state(into: dict, root: int, theta: float, seeds: list[int]) -> list[tuple[int, int, float, float, float]]:
    """State of the root's tree after seeds were taken in this order; an earlier seed whose path to the root
    leads over a later one is barred from the tree."""
    barred: set[int] = set()
    for k, u in enumerate(seeds[1:], 1):
        tree = influence_tree(into, root, theta, set(seeds[:k]), barred)
        if u not in tree:
            continue
        for s in seeds[:k]:
            node = s
            while node in tree and node not in (root, u):
                node = tree[node][0]
            if node == u and s in tree and s != u:
                barred = barred | {s}
    return tree_state(influence_tree(into, root, theta, set(seeds), barred), root, set(seeds))


def _greedy(lists: DataFrame, k: int, kernel: Callable[[int, dict, list[int]], list[tuple]], name: str) -> DataFrame:
    """k picks of the best node; kernel(root, lists, seeds) is a root's state."""
    seeds: list[int] = []
    taken: list[tuple[int, int, float]] = []

    def make(which: DataFrame, seeds: list[int]) -> DataFrame:
        return _by_root(which, lambda root, into: kernel(root, into, seeds), STATE)

    state = store(make(lists, seeds), name)
    for rank in range(1, k + 1):
        best = _best(state, seeds)
        if best is None:
            break
        u, score = best
        taken.append((rank, u, score))
        touched = state.where(F.col("node") == u).select("root").distinct()
        seeds = [*seeds, u]
        if rank < k:
            state = store(state.join(touched, "root", "left_anti").unionByName(make(lists.join(touched, "root", "left_semi"), seeds)), name)
    return lists.sparkSession.createDataFrame(taken, "rank int, node long, score double")


def pmia(arcs: DataFrame, k: int, theta: float = 1 / 20) -> DataFrame:
    """Maximum-influence arborescences on arcs (src, dst, p); seeds (rank, node, score).

    A path over an arc of theta or less is no likelier than theta, so such arcs are in no tree.
    """
    lists = _neighbourhoods(arcs, "p", lambda root, into: path_values(influence_tree(into, root, theta, set(), set())), theta, theta * (1 - 1e-9))
    return _greedy(lists, k, lambda root, into, seeds: pmia_state(into, root, theta, seeds), "pmia")


def dag_growth(into: dict, root: int, theta: float) -> tuple[dict[int, float], dict[int, list[tuple[int, float]]]]:
    """Influences of the members of the local DAG of root, and local_dag."""
    influence, heap, members, out = {root: 1.0}, [(-1.0, root)], {}, {}
    while heap:
        value, x = heapq.heappop(heap)
        if x in members or -value != influence[x]:
            continue
        if -value < theta and x != root:
            break
        members[x] = -value
        out.setdefault(x, [])
        for tail, b in into.get(x, ()):
            if tail not in members:
                out.setdefault(tail, []).append((x, b))
                influence[tail] = influence.get(tail, 0.0) + b * -value
                heapq.heappush(heap, (-influence[tail], tail))
    return members, {x: [(y, b) for y, b in arcs if y in members] for x, arcs in out.items() if x in members}


def local_dag(into: dict, root: int, theta: float) -> dict[int, list[tuple[int, float]]]:
    """node -> its arcs (head, b * w) inside the local DAG of root: nodes join by influence on it, at least theta."""
    return dag_growth(into, root, theta)[1]


def topological(arcs: dict[int, list[int]]) -> list[int]:
    """Nodes of a DAG, heads before tails (arcs: node -> heads); smaller nodes first; a cycle is an error."""
    left, tails = {x: len(set(ys)) for x, ys in arcs.items()}, {}
    for x, ys in arcs.items():
        for y in set(ys):
            tails.setdefault(y, []).append(x)
            left.setdefault(y, 0)
    heap, out = [x for x, n in left.items() if n == 0], []
    heapq.heapify(heap)
    while heap:
        y = heapq.heappop(heap)
        out.append(y)
        for x in tails.get(y, ()):
            left[x] -= 1
            if left[x] == 0:
                heapq.heappush(heap, x)
    if len(out) < len(left):
        raise ValueError("not a DAG")
    return out


def dag_state(dag: dict[int, list[tuple[int, float]]], root: int, seeds: set[int]) -> list[tuple[int, int, float, float, float]]:
    """Exact linear-threshold state of a local DAG with seeds: ap, alpha toward the root, and gains.

    alpha(x) is what a unit more of x's activation adds at the root; activation does not pass seeds.
    """
    order = topological({x: [y for y, _ in arcs] for x, arcs in dag.items()})
    alpha, ap = {x: 0.0 for x in dag}, {x: 1.0 if x in seeds else 0.0 for x in dag}
    alpha[root] = 1.0
    for x in order:
        if x != root:
            alpha[x] = sum(b * alpha[y] for y, b in dag[x] if y not in seeds)
    for x in reversed(order):
        for y, b in dag[x]:
            if y not in seeds:
                ap[y] += b * ap[x]
    if root in seeds:
        alpha = {x: 1.0 if x == root else 0.0 for x in dag}
    return [(root, x, alpha[x], ap[x], 0.0 if x in seeds else alpha[x] * (1 - ap[x])) for x in sorted(dag)]


def ldag(arcs: DataFrame, k: int, theta: float = 1 / 320) -> DataFrame:
    """Local DAGs for linear thresholds on arcs (src, dst, w, b); seeds (rank, node, score)."""
    weighted = arcs.withColumn("x", F.col("b") * F.col("w"))
    lists = _neighbourhoods(weighted, "x", lambda root, into: dag_growth(into, root, theta)[0], theta, -math.inf)

    def inside(root: int, into: dict) -> list[tuple[int, int, list[int], list[float]]]:
        return [(root, x, [y for y, _ in out], [b for _, b in out]) for x, out in local_dag(into, root, theta).items()]

    return _greedy(store(_by_root(lists, inside, LISTS), "dags"), k, lambda root, dag, seeds: dag_state(dag, root, set(seeds)), "ldag")

"""Reliability of pairs in uncertain graphs (undirected edges src < dst with p), exact in trees or sampled."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..schema import SEED, u01
from ..sources.readers import dense_ids
from ..storage import drop, store
from . import worlds as W

#: A whole uncertain graph that one task or the driver may hold, in edges.
KERNEL_EDGES = 4_000_000


def local(edges: DataFrame) -> list[tuple[int, int, float]]:
    """The edges (src, dst, p) on the driver, in order; refused above KERNEL_EDGES."""
    if edges.count() > KERNEL_EDGES:
        raise ValueError(f"this operator takes graphs of at most {KERNEL_EDGES} edges")
    return [(r["src"], r["dst"], r["p"]) for r in edges.select("src", "dst", "p").orderBy("src", "dst").collect()]


def on_one_task(edges: DataFrame, fn, schema: str) -> DataFrame:
    """fn(list of (src, dst, p)) -> rows, for steps that are sequential by nature; run in one executor task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["p"].tolist()))
        return pd.DataFrame(fn(rows), columns=[c.split()[0] for c in schema.split(", ")])

    if edges.count() > KERNEL_EDGES:
        raise ValueError(f"this operator takes graphs of at most {KERNEL_EDGES} edges")
    return edges.select("src", "dst", "p", F.lit(0).alias("one")).groupBy("one").applyInPandas(run, schema)


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The most probable spanning forest (src, dst, p): least -ln p, ties by (src, dst)."""
    if edges.count() > KERNEL_EDGES:
        return forest_by_rounds(edges)

    def run(rows):
        return [(u, v, p) for (u, v, p) in _forest(rows)]

    return on_one_task(edges, run, "src long, dst long, p double")


def forest_by_rounds(edges: DataFrame) -> DataFrame:
    """The same forest by joins: in a round every component takes its first edge to another, and merges.

    The order of edges is total, so no round closes a circle; components halve at least.
    """
    left, taken = store(edges.select("src", "dst", "p", F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b"), "left"), []
    while not left.isEmpty():
        edge = F.struct((-F.col("p")).alias("cost"), "src", "dst", "a", "b")
        first = left.select(F.explode(F.array("a", "b")).alias("comp"), edge.alias("e")).groupBy("comp").agg(F.min("e").alias("e"))
        pick = store(first.select("e.*").distinct(), "forest")
        taken.append(pick)
        comps = W.components(pick.select(F.lit(0).alias("world"), F.col("a").alias("src"), F.col("b").alias("dst")))
        for end in ("a", "b"):
            left = left.join(comps.select(F.col("node").alias(end), F.col("comp").alias(f"new_{end}")), end)
        left = store(left.where("new_a <> new_b").select("src", "dst", "p", F.col("new_a").alias("a"), F.col("new_b").alias("b")), "left")
    if not taken:
        return edges.select("src", "dst", "p").limit(0)
    return reduce(DataFrame.unionByName, taken).select("src", "dst", (-F.col("cost")).alias("p"))


def _forest(rows: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    p = {(u, v): x for u, v, x in rows}
    return [(u, v, p[u, v]) for _, u, v in kernels.spanning_forest([(-x, u, v) for u, v, x in rows])]


def peeled_forests(rows: list[tuple[int, int, float]]) -> list[list[tuple[int, int, float]]]:
    """Forests taken off one after another until no edge is left."""
    out, left = [], [e for e in rows if e[0] != e[1]]
    while left:
        forest = _forest(left)
        out.append(forest)
        gone = {(u, v) for u, v, _ in forest}
        left = [e for e in left if (e[0], e[1]) not in gone]
    return out


def forests(edges: DataFrame) -> DataFrame:
    """(tree, src, dst, p): all peeled forests, numbered from 0."""
    if edges.count() > KERNEL_EDGES:
        return peel_by_rounds(edges)
    return on_one_task(edges, lambda rows: [(i, *e) for i, f in enumerate(peeled_forests(rows)) for e in f], "tree long, src long, dst long, p double")


def peel_by_rounds(edges: DataFrame) -> DataFrame:
    """The same forests, each by rounds over the edges that those before left."""
    left, out = store(edges.select("src", "dst", "p").where("src <> dst"), "left"), []
    while not left.isEmpty():
        forest = store(forest_by_rounds(left), "forest")
        out.append(forest.select(F.lit(len(out)).cast("long").alias("tree"), "src", "dst", "p"))
        rest = store(left.join(forest.select("src", "dst"), ["src", "dst"], "left_anti"), "left")
        drop(left)
        left = rest
    return reduce(DataFrame.unionByName, out) if out else left.select(F.lit(0).cast("long").alias("tree"), "src", "dst", "p")


def tree_reliability(forest: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v, r) of pairs (u, v): the product of p along the only path, 0 if there is none.

    forest may hold several trees (column tree): their products are added.
    """
    rows = forest if "tree" in forest.columns else forest.withColumn("tree", F.lit(0).cast("long"))
    if rows.count() > KERNEL_EDGES:
        raise ValueError(f"forests of at most {KERNEL_EDGES} edges")
    trees: dict[int, list] = {}
    for r in rows.collect():
        trees.setdefault(r["tree"], []).append((r["src"], r["dst"], -math.log(r["p"]) if r["p"] > 0 else math.inf))
    shared = forest.sparkSession.sparkContext.broadcast({t: kernels.neighbours(e) for t, e in trees.items()})

    def run(it):
        for pdf in it:
            got, found = {}, []
            for u, v in zip(pdf["u"], pdf["v"]):
                total = 0.0
                for t, adj in shared.value.items():
                    if (t, u) not in got:
                        got[t, u] = kernels.shortest_paths(adj, u)[0] if u in adj else {}
                    if v in got[t, u]:
                        total += math.exp(-got[t, u][v])
                found.append(total)
            yield pdf.assign(r=found)

    return pairs.select("u", "v").orderBy("u", "v").mapInPandas(run, "u long, v long, r double")


def sampled_reliability(edges: DataFrame, worlds: int, pairs: DataFrame | None = None, cutoff: float = 0.0, seed: int = SEED) -> DataFrame:
    """(u, v, r), u < v: the share of worlds where both are in one component; shares under cutoff / worlds go.

    Given pairs are looked up by joins on their two ends; only without them are all pairs of a component
    listed, which is for small graphs.
    """
    comps = W.components(W.live_edges(edges.withColumn("w", F.lit(1)), worlds, F.col("p"), seed))
    if pairs is None:
        a = comps.select("world", "comp", F.col("node").alias("u"))
        b = comps.select("world", "comp", F.col("node").alias("v"))
        both = a.join(b, ["world", "comp"]).where("u < v").select("world", "u", "v")
    else:
        a = comps.select("world", F.col("node").alias("u"), F.col("comp").alias("cu"))
        b = comps.select("world", F.col("node").alias("v"), F.col("comp").alias("cv"))
        both = pairs.select("u", "v").join(a, "u").join(b, ["world", "v"]).where("cu = cv").select("world", "u", "v")
    return both.groupBy("u", "v").agg((F.count("*") / F.lit(worlds)).alias("r")).where(F.col("r") >= cutoff / worlds)


def world_reliability(live: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v, r): 1 if one world (src, dst) connects the pair, else 0."""
    comps = W.components(live.withColumn("world", F.lit(0)))
    a, b = comps.select(F.col("node").alias("u"), F.col("comp").alias("cu")), comps.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
    return pairs.select("u", "v").join(a, "u", "left").join(b, "v", "left").select("u", "v", F.coalesce((F.col("cu") == F.col("cv")).cast("double"), F.lit(0.0)).alias("r"))


def discrepancy(a: DataFrame, b: DataFrame) -> DataFrame:
    """(total, mean) of |r_a - r_b| over the pairs that either has; a missing r is 0."""
    both = a.select("u", "v", F.col("r").alias("ra")).join(b.select("u", "v", F.col("r").alias("rb")), ["u", "v"], "full_outer")
    gap = F.abs(F.coalesce("ra", F.lit(0.0)) - F.coalesce("rb", F.lit(0.0)))
    return both.agg(F.sum(gap).alias("total"), F.avg(gap).alias("mean"))


def random_pairs(nodes: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """n different pairs u < v, or all pairs where there are no more.

    Draw k takes the nodes at two hashed places of the id order. Draws of one node and of a pair that
    was drawn before are passed over, and the first n of the others count, whatever the number of nodes
    (up to 2**32, the coin's resolution). So about 2n draws are made and all pairs are never listed.
    """
    ranks = dense_ids(nodes.select("node").distinct(), "node", ["node"])
    total = ranks.count()
    a, b = ranks.select(F.col("id").alias("x"), F.col("node").alias("u")), ranks.select(F.col("id").alias("y"), F.col("node").alias("v"))
    if total * (total - 1) // 2 <= n:
        return a.join(b, F.col("x") < F.col("y")).select("u", "v")  # n rows at most
    draws = 2 * n + 16
    while True:
        places = nodes.sparkSession.range(draws).select(F.col("id").alias("k"), *[F.floor(u01(seed, tag, F.col("id")) * total).alias(tag) for tag in ("pa", "pb")]).where("pa <> pb")
        pairs = places.groupBy(F.least("pa", "pb").alias("x"), F.greatest("pa", "pb").alias("y")).agg(F.min("k").alias("k"))
        if pairs.count() >= n:
            return pairs.orderBy("k").limit(n).join(a, "x").join(b, "y").select("u", "v")
        draws *= 2


def error_curve(edges: DataFrame, u: int, v: int, truth: float, worlds: int, seed: int = SEED) -> DataFrame:
    """(worlds, error): |estimate - truth| of one pair after each further world."""
    comps = W.components(W.live_edges(edges.withColumn("w", F.lit(1)), worlds, F.col("p"), seed))
    a, b = comps.where(F.col("node") == u).select("world", F.col("comp").alias("cu")), comps.where(F.col("node") == v).select("world", F.col("comp").alias("cv"))
    hit = a.join(b, "world").select(F.col("world").cast("long").alias("world"), (F.col("cu") == F.col("cv")).cast("int").alias("hit"))
    rows = edges.sparkSession.range(worlds).withColumnRenamed("id", "world").join(hit, "world", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    mean = F.avg("hit").over(Window.orderBy("world").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select((F.col("world") + 1).alias("worlds"), F.abs(mean - truth).alias("error"))

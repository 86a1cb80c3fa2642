"""Possible worlds: all sampled graphs in one DataFrame live(world, src, dst), and what can be reached.

A world is a kernel's group as long as its live edges fit in a task (KERNEL_EDGES); larger worlds are
searched by joins over all worlds at once, with each round's rows written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..schema import P, SEED, fires, u01
from ..storage import drop, store

KERNEL_EDGES = 4_000_000
#: Arcs of a world that one task counts reach over; larger worlds are counted by parts of the reached nodes, COUNT_PARTS at most.
COUNT_ARCS, COUNT_PARTS = 30_000, 16


def live_edges(edges: DataFrame, worlds: int, p: Column | float = P, seed: int = SEED, first: int = 0, tag: str | None = None) -> DataFrame:
    """Edges (src, dst, w) that fire in each of the worlds first .. first + worlds - 1."""
    rows = edges.withColumn("world", F.explode(F.sequence(F.lit(first), F.lit(first + worlds - 1))))
    parts = [tag] if tag else []
    coin = u01(seed, *parts, F.col("world"), F.col("src"), F.col("dst"))
    return rows.where(coin <= fires("w", p)).select("world", "src", "dst")


def largest(live: DataFrame) -> int:
    return live.groupBy("world").count().agg(F.max("count")).head()[0] or 0


def fits(live: DataFrame) -> bool:
    return largest(live) <= KERNEL_EDGES


def few(edges: DataFrame) -> bool:
    """Whether any world of edges fits, both ways, without sampling one to see."""
    return 2 * edges.count() <= KERNEL_EDGES


def _both(live: DataFrame) -> DataFrame:
    return live.select("world", "src", "dst").unionByName(live.select("world", F.col("dst").alias("src"), F.col("src").alias("dst")))


def reach(live: DataFrame, seeds: DataFrame, worlds: int, undirected: bool = False, kernel: bool | None = None, first: int = 0) -> DataFrame:
    """(world, node, level): what seeds (node) activate in every world, with the fewest steps."""
    live = _both(live) if undirected else live
    start = seeds.select("node").distinct()
    every = start.withColumn("world", F.explode(F.sequence(F.lit(first), F.lit(first + worlds - 1)))).select("world", "node", F.lit(0).alias("level"))
    if fits(live) if kernel is None else kernel:
        ids = np.array(sorted(r["node"] for r in start.collect()))  # seeds: k of them

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            g = kernels.Arcs(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
            got = kernels.levels(g, g.number(ids))
            hit = np.flatnonzero(got > 0)
            return pd.DataFrame({"world": pdf["world"].iloc[0], "node": g.names[hit], "level": got[hit]})

        return every.unionByName(live.groupBy("world").applyInPandas(run, "world int, node long, level int"))
    known = store(every, "reach")
    live = store(live, "live")
    level = 0
    while True:
        front = known.where(F.col("level") == level).select("world", F.col("node").alias("src"))
        step = live.join(front, ["world", "src"]).select("world", F.col("dst").alias("node")).distinct().join(known.select("world", "node"), ["world", "node"], "left_anti")
        level += 1
        new = store(step.withColumn("level", F.lit(level)), "reach")
        if new.isEmpty():
            return known
        merged = store(known.unionByName(new), "reach")
        drop(known)
        drop(new)
        known = merged


def _closure(live: DataFrame, start: DataFrame, least: bool = False) -> DataFrame:
    """(world, node, tag): the tags of start (world, node, tag), carried along live arcs by joins.

    A node gets every tag that reaches it, or the least one only. A round joins the arcs with the rows
    that were new in the round before, and its rows are one more table in the shared folder.
    """
    parts = [store(start.select("world", "node", "tag").distinct(), "closure")]
    while True:
        known = reduce(DataFrame.unionByName, parts)
        step = live.join(parts[-1].withColumnRenamed("node", "src"), ["world", "src"]).select("world", F.col("dst").alias("node"), "tag")
        if least:
            known = known.groupBy("world", "node").agg(F.min("tag").alias("tag"))
            found = step.groupBy("world", "node").agg(F.min("tag").alias("tag")).join(known.withColumnRenamed("tag", "held"), ["world", "node"], "left")
            step = found.where(F.col("held").isNull() | (F.col("tag") < F.col("held"))).select("world", "node", "tag")
        else:
            step = step.distinct().join(known, ["world", "node", "tag"], "left_anti")
        new = store(step, "closure")
        if new.isEmpty():
            drop(new)
            return known
        parts.append(new)


def _nodes(live: DataFrame) -> DataFrame:
    return live.select("world", F.explode(F.array("src", "dst")).alias("node")).distinct()


def _every_world(rows: DataFrame, worlds: int) -> DataFrame:
    return rows.withColumn("world", F.explode(F.sequence(F.lit(0), F.lit(worlds - 1))))


def reach_of_sets(live: DataFrame, sets: DataFrame, worlds: int) -> DataFrame:
    """(world, set, node): all that each of the sets (set, node) activates, by joins."""
    start = _every_world(sets.select("node", F.col("set").alias("tag")), worlds)
    return _closure(store(live, "live"), start).select("world", F.col("tag").alias("set"), "node")


def first_seed_rank(live: DataFrame, seeds: DataFrame, worlds: int, undirected: bool = False, kernel: bool | None = None) -> DataFrame:
    """(world, node, rank): the first of the ordered seeds (rank, node) that reaches each node."""
    live = _both(live) if undirected else live
    if not (fits(live) if kernel is None else kernel):
        start = _every_world(seeds.select("node", F.col("rank").cast("long").alias("tag")), worlds)
        return _closure(store(live, "live"), start, least=True).groupBy("world", "node").agg(F.min("tag").alias("rank"))
    rows = seeds.orderBy("rank").select("rank", "node").collect()  # k seeds
    ids, ranks = np.array([r["node"] for r in rows], np.int64), np.array([r["rank"] for r in rows], np.int64)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = kernels.Arcs(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
        got = kernels.first_rank(g, g.number(ids))
        hit = np.flatnonzero(got >= 0)
        return pd.DataFrame({"world": pdf["world"].iloc[0], "node": g.names[hit], "rank": ranks[got[hit]]})

    reached = live.groupBy("world").applyInPandas(run, "world int, node long, rank long")
    own = seeds.select("node", F.col("rank").cast("long").alias("rank")).withColumn("world", F.explode(F.sequence(F.lit(0), F.lit(worlds - 1)))).select("world", "node", "rank")
    return reached.unionByName(own).groupBy("world", "node").agg(F.min("rank").alias("rank"))


def components(live: DataFrame, nodes: DataFrame | None = None, worlds: int = 0, kernel: bool | None = None) -> DataFrame:
    """(world, node, comp): components, edges read both ways; comp is the smallest node.

    With nodes and worlds, nodes without live edges are components of their own.
    """
    if fits(live) if kernel is None else kernel:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            node, comp = kernels.components(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
            return pd.DataFrame({"world": pdf["world"].iloc[0], "node": node, "comp": comp})

        out = live.groupBy("world").applyInPandas(run, "world int, node long, comp long")
    else:
        out = _components_by_joins(live)
    if nodes is None:
        return out
    every = nodes.withColumn("world", F.explode(F.sequence(F.lit(0), F.lit(worlds - 1))))
    return every.join(out, ["world", "node"], "left").select("world", "node", F.coalesce("comp", "node").alias("comp"))


def _components_by_joins(live: DataFrame) -> DataFrame:
    """Large-star and small-star rounds over all worlds, until no edge changes."""
    now, seen = store(live.where("src <> dst").select("world", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "stars"), None
    while True:
        both = now.select("world", F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("world", F.col("b"), F.col("a")))
        low = both.groupBy("world", "u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.where("v > u").join(low, ["world", "u"]).select("world", F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        least = large.groupBy("world", "b").agg(F.min("a").alias("m"))
        small = large.join(least, ["world", "b"]).select("world", F.col("m"), F.explode(F.array("a", "b")).alias("b")).select("world", F.col("m").alias("a"), "b").where("a < b").distinct()
        after = store(small, "stars")
        drop(now)
        now = after
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("world", "a", "b").cast("decimal(38,0)"))).head())
        if state == seen:
            break
        seen = state
    alone = live.where("src = dst").select("world", F.col("src").alias("node"), F.col("src").alias("comp"))
    out = now.select("world", F.col("b").alias("node"), F.col("a").alias("comp")).union(now.select("world", "a", "a")).union(alone)
    return out.groupBy("world", "node").agg(F.min("comp").alias("comp"))


def component_sizes(comps: DataFrame) -> DataFrame:
    return comps.groupBy("world", "comp").agg(F.count("*").alias("size"))


def strong_components(live: DataFrame, kernel: bool | None = None) -> DataFrame:
    """(world, node, scc): strongly connected components of nodes with live arcs; scc is the smallest node."""
    if not (fits(live) if kernel is None else kernel):
        return _strong_by_joins(live)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = kernels.Arcs(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
        return pd.DataFrame({"world": pdf["world"].iloc[0], "node": g.names, "scc": g.names[kernels.strong(g)]})

    return live.groupBy("world").applyInPandas(run, "world int, node long, scc long")


def _strong_by_joins(live: DataFrame) -> DataFrame:
    """Colour every node by the first one, in hashed order, that reaches it; those of a colour that reach
    its root are the root's component. They are taken out, and the rest is coloured again."""
    left, arcs, done = store(_nodes(live), "left"), store(live.where("src <> dst").distinct(), "arcs"), []
    while not left.isEmpty():
        start = left.withColumn("tag", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("root")))
        colour = store(_closure(arcs, start, least=True), "colour")
        src, dst = (colour.select("world", F.col("node").alias(end), F.col("tag").alias(f"{end}_tag")) for end in ("src", "dst"))
        inside = arcs.join(src, ["world", "src"]).join(dst, ["world", "dst"]).where("src_tag = dst_tag")
        back = store(inside.select("world", F.col("dst").alias("src"), F.col("src").alias("dst")), "back")
        part = store(_closure(back, colour.where("node = tag.root")), "scc")
        done.append(part)
        rest = store(left.join(part, ["world", "node"], "left_anti"), "left")
        ends = [rest.withColumnRenamed("node", end) for end in ("src", "dst")]
        fewer = store(arcs.join(ends[0], ["world", "src"], "left_semi").join(ends[1], ["world", "dst"], "left_semi").select("world", "src", "dst"), "arcs")
        for old in (left, arcs, colour, back):
            drop(old)
        left, arcs = rest, fewer
    if not done:
        return live.select("world", F.col("src").alias("node"), F.col("src").alias("scc"))  # no rows
    rows = reduce(DataFrame.unionByName, done)
    name = rows.groupBy("world", "tag").agg(F.min("node").alias("scc"))
    return rows.join(name, ["world", "tag"]).select("world", "node", "scc")


def condensation(live: DataFrame, scc: DataFrame) -> DataFrame:
    """(world, src_c, dst_c): arcs between different components."""
    a = scc.select("world", F.col("node").alias("src"), F.col("scc").alias("src_c"))
    b = scc.select("world", F.col("node").alias("dst"), F.col("scc").alias("dst_c"))
    return live.join(a, ["world", "src"]).join(b, ["world", "dst"]).where("src_c <> dst_c").select("world", "src_c", "dst_c").distinct()


def reach_sizes(live: DataFrame, method: str = "topsort", kernel: bool | None = None) -> DataFrame:
    """(world, node, size): how many nodes each reaches, itself included.

    topsort: unions over the condensation in reverse topological order, as bit sets of bounded size;
    bfs: a search from each node; both by joins from all nodes at once where a world doesn't fit in a task.
    """
    most = largest(live)
    if not (most <= KERNEL_EDGES if kernel is None else kernel):
        pairs = _closure(store(live, "live"), _nodes(live).withColumn("tag", F.col("node")))
        return pairs.groupBy("world", F.col("tag").alias("node")).agg(F.count("*").alias("size"))

    parts = min(COUNT_PARTS, 1 + most // COUNT_ARCS)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        g = kernels.Arcs(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
        return pd.DataFrame({"world": pdf["world"].iloc[0], "node": g.names, "size": kernels.reach_counts(g, int(pdf["part"].iloc[0]), parts)})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        g = kernels.Arcs(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
        size = [int((kernels.levels(g, np.array([v])) >= 0).sum()) for v in range(g.n)]
        return pd.DataFrame({"world": pdf["world"].iloc[0], "node": g.names, "size": size})

    if method == "topsort":
        dealt = live.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        found = dealt.groupBy("world", "part").applyInPandas(count, "world int, node long, size long")
        return found.groupBy("world", "node").agg(F.sum("size").alias("size")) if parts > 1 else found
    return live.groupBy("world").applyInPandas(search, "world int, node long, size long")


def reach_pairs(live: DataFrame, kernel: bool | None = None) -> DataFrame:
    """(world, u, v): v is reached from u over one arc or more; u itself is left out."""
    if not (fits(live) if kernel is None else kernel):
        pairs = _closure(store(live, "live"), _nodes(live).withColumn("tag", F.col("node")))
        return pairs.where("node <> tag").select("world", F.col("tag").alias("u"), F.col("node").alias("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = kernels.Arcs(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
        pairs = [(u, v) for u, s in enumerate(kernels.reach_sets(g)) for v in s if v != u]
        u, v = np.array(pairs, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"world": pdf["world"].iloc[0], "u": g.names[u], "v": g.names[v]})

    return live.groupBy("world").applyInPandas(run, "world int, u long, v long")


def one_hop(live: DataFrame, seeds: DataFrame) -> DataFrame:
    """(world, node): seeds and their direct successors only."""
    start = seeds.select(F.col("node").alias("src"))
    step = live.join(start, "src", "left_semi").select("world", F.col("dst").alias("node"))
    worlds = live.select("world").distinct().crossJoin(F.broadcast(seeds.select("node")))
    return step.union(worlds.select("world", "node")).distinct()


def ranked_sizes(comps: DataFrame) -> DataFrame:
    """(world, comp, size, place, total): components by size, with the running total."""
    order = Window.partitionBy("world").orderBy(F.desc("size"), "comp")
    sizes = component_sizes(comps)
    return sizes.withColumn("place", F.row_number().over(order)).withColumn("total", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def components_for_target(comps: DataFrame, target: int) -> DataFrame:
    """(world, needed, covered): the fewest largest components that hold ``target`` nodes; all if they can't."""
    ranked = ranked_sizes(comps)
    enough = F.when(F.col("total") >= target, F.struct("place", "total"))
    got = ranked.groupBy("world").agg(F.min(enough).alias("first"), F.max(F.struct("place", "total")).alias("all"))
    pick = F.coalesce("first", "all")
    return got.select("world", pick["place"].cast("long").alias("needed"), pick["total"].alias("covered"))


def size_histogram(comps: DataFrame, target: int) -> DataFrame:
    """(world, size, n, qualified): components of each size; sizes are qualified from the largest down
    while the sum of the different sizes before stays under ``target``."""
    order = Window.partitionBy("world").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    hist = component_sizes(comps).groupBy("world", "size").agg(F.count("*").alias("n"))
    return hist.withColumn("qualified", F.coalesce(F.sum("size").over(order), F.lit(0)) < target)


def components_for_targets(comps: DataFrame, targets: list[int]) -> DataFrame:
    """(world, target, needed) for many targets; a target out of reach has no row."""
    want = F.explode(F.array(*[F.lit(t).cast("long") for t in targets])).alias("target")
    ranked = ranked_sizes(comps).select("world", "place", "total", want)
    return ranked.where("total >= target").groupBy("world", "target").agg(F.min("place").cast("long").alias("needed"))

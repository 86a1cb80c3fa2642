"""Diffusion: independent cascades (one p or p per edge) and linear thresholds, over all worlds at once."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import P, SEED, u01
from . import worlds as W


def cascade(edges: DataFrame, seeds: DataFrame, worlds: int, p: Column | float = P, undirected: bool = False, seed: int = SEED) -> DataFrame:
    """(world, node, level): nodes that seeds activate. An edge gets one try, so a world's live edges decide."""
    return W.reach(W.live_edges(edges, worlds, p, seed), seeds, worlds, undirected, W.few(edges) or None)


def mean_spread(active: DataFrame, worlds: int) -> DataFrame:
    """The expected number of activated nodes."""
    return active.agg((F.count("*") / F.lit(worlds)).alias("spread"))


def spread_curve(edges: DataFrame, seeds: DataFrame, worlds: int, p: Column | float = P, undirected: bool = False, seed: int = SEED) -> DataFrame:
    """(k, spread) for all prefixes of ordered seeds (rank from 1, node), in one job."""
    reached = W.first_seed_rank(W.live_edges(edges, worlds, p, seed), seeds, worlds, undirected, W.few(edges) or None)
    gains = seeds.select(F.col("rank").cast("long").alias("k")).join(reached.groupBy(F.col("rank").alias("k")).agg(F.count("*").alias("n")), "k", "left")
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return gains.select("k", (total / F.lit(worlds)).alias("spread"))


def spread_by_worlds(active: DataFrame, worlds: int) -> DataFrame:
    """(r, spread): the estimate from the first r worlds, for every r."""
    sizes = active.groupBy("world").agg(F.count("*").alias("n"))
    order = Window.orderBy("world").rowsBetween(Window.unboundedPreceding, 0)
    return sizes.select((F.col("world") + 1).cast("long").alias("r"), (F.sum("n").over(order) / (F.col("world") + 1)).alias("spread"))


def spread_of_sets(edges: DataFrame, sets: DataFrame, worlds: int, p: Column | float = P, seed: int = SEED) -> DataFrame:
    """(set, spread) of stored seed sets (set, node), over the same worlds."""
    live = W.live_edges(edges, worlds, p, seed)
    if not (W.few(edges) or W.fits(live)):
        reached = W.reach_of_sets(live, sets, worlds)
        return reached.groupBy("set").agg((F.count("*") / F.lit(worlds)).alias("spread"))
    held = {k: np.array(v) for k, v in ((r["set"], r["nodes"]) for r in sets.groupBy("set").agg(F.collect_set("node").alias("nodes")).collect())}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from ..functions import kernels

        g = kernels.Arcs(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
        rows = []
        for k, nodes in held.items():
            at = g.number(nodes)
            rows.append((k, int((kernels.levels(g, at) >= 0).sum()) + int((at < 0).sum())))
        return pd.DataFrame(rows, columns=["set", "n"]).assign(world=pdf["world"].iloc[0])[["world", "set", "n"]]

    kind = sets.schema["set"].dataType.simpleString()
    sizes = live.groupBy("world").applyInPandas(run, f"world int, set {kind}, n long")
    own = sets.groupBy("set").agg(F.countDistinct("node").alias("own"))
    got = sizes.groupBy("set").agg(F.sum("n").alias("n"), F.count("*").alias("seen"))
    return own.join(got, "set", "left").select("set", ((F.coalesce("n", F.lit(0)) + (F.lit(worlds) - F.coalesce("seen", F.lit(0))) * F.col("own")) / F.lit(worlds)).alias("spread"))


def thresholds(nodes: DataFrame, worlds: int, seed: int = SEED) -> DataFrame:
    """(world, node, threshold): one uniform draw for each node and world."""
    rows = nodes.withColumn("world", F.explode(F.sequence(F.lit(0), F.lit(worlds - 1))))
    return rows.select("world", "node", u01(seed, "thr", F.col("world"), F.col("node")).alias("threshold"))


def linear_threshold(edges: DataFrame, seeds: DataFrame, worlds: int, levels: int | None = None, seed: int = SEED) -> DataFrame:
    """(world, node, level): a node is activated when b * w of its active predecessors reach its threshold.

    The graph is one for all worlds, so it goes to each task, which runs some of the worlds; rounds go on
    until nothing changes, or for ``levels`` where that is given. Weights are rounded to 12 digits, so that summation order can't decide.
    """
    rows = edges.select("src", "dst", F.round(F.col("b") * F.col("w"), 12).alias("x"))
    if rows.count() > W.KERNEL_EDGES:
        return _linear_threshold_by_joins(rows, seeds, worlds, levels, seed)
    data = rows.toPandas()
    a, b, x = data["src"].to_numpy(), data["dst"].to_numpy(), data["x"].to_numpy()
    nodes, packed = np.unique(np.concatenate([a, b]), return_inverse=True)
    start = np.array(sorted(r["node"] for r in seeds.select("node").distinct().collect()))
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast((packed[: len(a)], packed[len(a) :], x, nodes, start))
    draws = thresholds(spark.createDataFrame(pd.DataFrame({"node": nodes})), worlds, seed)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, x, nodes, start = shared.value
        theta = pdf.sort_values("node")["threshold"].to_numpy()
        level = np.where(np.isin(nodes, start), 0, -1)
        for step in itertools.count(1) if levels is None else range(1, levels + 1):
            pull = np.bincount(b, x * (level[a] >= 0), len(nodes))
            new = (level < 0) & (pull > 0) & (np.round(pull, 9) >= theta)
            if not new.any():
                break
            level[new] = step
        hit = np.flatnonzero(level >= 0)
        return pd.DataFrame({"world": pdf["world"].iloc[0], "node": nodes[hit], "level": level[hit]})

    return draws.groupBy("world").applyInPandas(run, "world int, node long, level int")


def _linear_threshold_by_joins(rows: DataFrame, seeds: DataFrame, worlds: int, levels: int | None, seed: int) -> DataFrame:
    from ..storage import drop, store

    active = store(seeds.select("node").distinct().withColumn("world", F.explode(F.sequence(F.lit(0), F.lit(worlds - 1)))).select("world", "node", F.lit(0).alias("level")), "lt")
    for step in itertools.count(1) if levels is None else range(1, levels + 1):
        pull = rows.join(active.select("world", F.col("node").alias("src")), "src").groupBy("world", F.col("dst").alias("node")).agg(F.round(F.sum("x"), 9).alias("pull"))
        due = pull.where(F.col("pull") >= u01(seed, "thr", F.col("world"), F.col("node"))).join(active.select("world", "node"), ["world", "node"], "left_anti")
        new = store(due.select("world", "node", F.lit(step).alias("level")), "lt")
        if new.isEmpty():
            break
        before, active = active, store(active.unionByName(new), "lt")
        drop(before)
        drop(new)
    return active

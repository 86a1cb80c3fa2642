"""Relabelling, pruning and shaping of graphs and action logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import dense_ids, remap
from . import models


def first_seen_ids(edges: DataFrame) -> DataFrame:
    """(old, new): nodes of edges (line, src, dst) numbered in the order they are first seen."""
    ends = edges.select("line", F.posexplode(F.array("src", "dst")).alias("pos", "old"))
    return dense_ids(ends, "old", ["line", "pos"]).select("old", F.col("id").alias("new"))


def clean_graph(edges: DataFrame, model: str = "no_model", **options) -> DataFrame:
    """Edges (line, src, dst) renumbered densely as first seen; an edge model may add p."""
    made = remap(edges.drop("line"), first_seen_ids(edges))
    if model == "no_model":
        return made
    counted = made.groupBy("src", "dst").agg(F.count("*").alias("w"))
    fit = {"wc": models.weighted_cascade, "multivalency": models.multivalency, "random": models.random, "uniform": models.uniform}[model]
    return fit(counted, **options)


def relabel_actions(edges: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph and its action log (src nullable, dst, action) under dense ids.

    Actions on unknown nodes and actions of a node on itself go.
    """
    ids = first_seen_ids(edges)
    b = ids.select(F.col("old").alias("dst"), F.col("new").alias("new_dst"))
    a = ids.select(F.col("old").alias("src"), F.col("new").alias("new_src"))
    known = actions.join(b, "dst").join(a, "src", "left").where("src IS NULL OR (new_src IS NOT NULL AND src <> dst)")
    return remap(edges.drop("line"), ids), known.select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "action")


def prune(edges: DataFrame, n: int) -> DataFrame:
    """Edges among the first n nodes seen, each admitted by its own line or an earlier one."""
    keep = first_seen_ids(edges).where(F.col("new") < n)
    for end in ("src", "dst"):
        edges = edges.join(keep.select(F.col("old").alias(end)), end, "left_semi")
    return edges


def almost_equal(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return F.abs(a - b) < eps


def ego_edges(edges: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """Edges met within ``radius`` steps from seeds (node), arcs both ways; a self-loop (u, u, 1) marks each seed."""
    front = seeds.select("node").distinct()
    found = seeds.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1).cast("long").alias("w")).distinct()
    for _ in range(radius):
        step = edges.join(front.select(F.col("node").alias("src")), "src", "left_semi")
        found = found.unionByName(step.select("src", "dst", "w"))
        front = front.union(step.select(F.col("dst").alias("node"))).distinct()
    return found.distinct()


def spread_edges(edges: DataFrame, active: DataFrame) -> DataFrame:
    """Edges between activated nodes (node, level), from the earlier activated end; seeds' stars included."""
    a, b = active.select(F.col("node").alias("src"), F.col("level").alias("from_level")), active.select(F.col("node").alias("dst"), F.col("level").alias("to_level"))
    out = edges.join(a, "src").join(b, "dst", "left").where("from_level = 0 OR from_level < to_level")
    return out.select("src", "dst", "w", "from_level", "to_level", F.when(F.col("to_level").isNull(), "star").otherwise("spread").alias("role"))


def mean_probability(arcs: DataFrame) -> DataFrame:
    """Directed to undirected: the mean of the two arcs' p, where both are present."""
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("p").alias("q"))
    return arcs.where("src < dst").join(back, ["src", "dst"]).select("src", "dst", ((F.col("p") + F.col("q")) / 2).alias("p"))


def percentage_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean of (a - b) / b over the points (k, y) that both curves have."""
    both = a.select("k", F.col("y").alias("a")).join(b.select("k", F.col("y").alias("b")), "k")
    return both.agg(F.avg((F.col("a") - F.col("b")) / F.col("b")).alias("difference"))


def diameters(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """(comp, nodes, diameter) by breadth-first searches, from as many nodes of a component as its bounds need.

    A component is one group, so each must fit in a task; undirected edges.
    """
    import pandas as pd

    from ..functions import kernels

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["src"].to_numpy(), pdf["dst"].to_numpy()
        import numpy as np

        g = kernels.Arcs(np.concatenate([a, b]), np.concatenate([b, a]))
        return pd.DataFrame({"comp": [pdf["comp"].iloc[0]], "nodes": [g.n], "diameter": [kernels.diameter(g)]})

    tagged = edges.join(comps.select(F.col("node").alias("src"), "comp"), "src").select("comp", "src", "dst")
    return tagged.groupBy("comp").applyInPandas(run, "comp long, nodes long, diameter long")


def running_total(column: str, *order) -> Column:
    return F.sum(column).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))

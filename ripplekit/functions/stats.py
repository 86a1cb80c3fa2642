"""Small aggregates, graph statistics and plot-ready tables."""

from __future__ import annotations

import heapq
import itertools
import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PriorityQueue:
    """Least priority first, earliest added on ties; tasks can be changed and removed. For driver-side kernels."""

    def __init__(self):
        self._heap, self._at, self._turn = [], {}, itertools.count()

    def add_task(self, task, priority=0) -> None:
        entry = (priority, next(self._turn), task)
        self._at[task] = entry
        heapq.heappush(self._heap, entry)

    def remove_task(self, task) -> None:
        del self._at[task]

    def pop_item(self):
        while self._heap:
            entry = heapq.heappop(self._heap)
            if self._at.get(entry[2]) is entry:
                del self._at[entry[2]]
                return entry[2], entry[0]
        raise KeyError("pop from an empty priority queue")

    def __len__(self) -> int:
        return len(self._at)


def mean_or_zero(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def min_or_infinity(c: Column) -> Column:
    return F.coalesce(F.min(c).cast("double"), F.lit(float("inf")))


def by_value(scores: DataFrame, descending: bool = True) -> DataFrame:
    return scores.orderBy(F.desc("score") if descending else F.asc("score"), "node")


@contextmanager
def timed(into: dict, name: str):
    """Adds the seconds a block takes to ``into[name]``."""
    began = time.perf_counter()
    try:
        yield
    finally:
        into[name] = into.get(name, 0.0) + time.perf_counter() - began


def graph_statistics(edges: DataFrame, comps: DataFrame | None = None) -> DataFrame:
    """One row for undirected edges (src < dst): nodes, edges, mean and greatest degree, triangles, clustering."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    degree = ends.groupBy("node").agg(F.count("*").alias("d"))
    base = degree.agg(F.count("*").alias("nodes"), (F.sum("d") / 2).cast("long").alias("edges"), F.avg("d").alias("mean_degree"), F.max("d").alias("max_degree"), F.sum(F.col("d") * (F.col("d") - 1) / 2).alias("wedges"))
    # edges point from the end of lower degree, so that no node has many of them out
    ranked = edges.join(degree.select(F.col("node").alias("src"), F.col("d").alias("ds")), "src").join(degree.select(F.col("node").alias("dst"), F.col("d").alias("dd")), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    out = ranked.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
    wedge = out.join(out.select("a", F.col("b").alias("c")), "a").where("b <> c")
    closed = wedge.join(out.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"]).agg(F.count("*").alias("triangles"))
    both = base.crossJoin(closed)  # one row each
    return both.select("nodes", "edges", "mean_degree", "max_degree", "triangles", F.when(F.col("wedges") > 0, 3 * F.col("triangles") / F.col("wedges")).otherwise(0.0).alias("clustering"))


def summary(values: DataFrame, column: str) -> DataFrame:
    """mean, population deviation and median."""
    return values.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.percentile(column, 0.5).alias("median"))


def series(named: dict[str, DataFrame], x: str, y: str) -> DataFrame:
    """Plot-ready rows (series, x, y) of several curves."""
    out = None
    for name, df in named.items():
        part = df.select(F.lit(name).alias("series"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        out = part if out is None else out.unionByName(part)
    return out

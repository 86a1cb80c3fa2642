"""Seed minimization: the fewest seeds whose expected spread reaches a target.

All methods share one step. Their orders don't depend on k, so the spread of every prefix of an order
comes from one job (``diffusion.spread_curve``), and the answer is the first prefix that reaches the
target. The curve never falls, since the worlds are shared; nothing has to be bisected. ``probes``
replays doubling and bisection on the curve, to tell how many estimates that search would take.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import P, SEED
from . import diffusion, selection
from . import worlds as W


def fewest(curve: DataFrame, targets: list[float]) -> DataFrame:
    """(target, k, spread): the first point of curve (k, spread) with spread >= target; none, no row."""
    want = curve.withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    first = want.where("spread >= target").groupBy("target").agg(F.min(F.struct("k", "spread")).alias("f"))
    return first.select("target", "f.k", "f.spread")


def probes(spread: Callable[[int], float], target: float, most: int) -> tuple[int, int]:
    """(k, estimates): doubling until the target is reached, then bisection."""
    steps, high = 1, 1
    while high < most and spread(high) < target:
        high, steps = min(2 * high, most), steps + 1
    low = high // 2
    while high - low > 1:
        mid, steps = (low + high) // 2, steps + 1
        low, high = (low, mid) if spread(mid) >= target else (mid, high)
    return high, steps


def search_steps(curve: DataFrame, targets: list[float]) -> DataFrame:
    """(target, k, steps) of the doubling search; the curve has a point for each k, k seeds in all."""
    at = {r["k"]: r["spread"] for r in curve.collect()}
    rows = [(float(t), *probes(lambda k: at[k], t, max(at))) for t in targets if at and at[max(at)] >= t]
    return curve.sparkSession.createDataFrame(rows, "target double, k int, steps int")


def minimize(edges: DataFrame, seeds: DataFrame, targets: list[float], worlds: int, p: Column | float = P, undirected: bool = True, seed: int = SEED) -> DataFrame:
    """The fewest first seeds of an order (rank, node) for each target."""
    return fewest(diffusion.spread_curve(edges, seeds, worlds, p, undirected, seed), targets)


def reverse_scores(comps: DataFrame, target: int, widen: float = 1.0, ties: bool = False, least: int = 0, score: str = "1/(size*L)") -> DataFrame:
    """(node, score) from the components needed for ``target``.

    L is the fewest largest components that hold the target; the first int(widen * L) of them score
    (ties: also those as large as the last; least: those of at least that size instead). score is SQL
    on size, L, qualified (the number that score) and rank.
    """
    ranked = W.ranked_sizes(comps).join(W.components_for_target(comps, target).select("world", F.col("needed").alias("L")), "world").withColumn("rank", F.col("place"))
    if least:
        kept = ranked.where(F.col("size") >= least)
    else:
        kept = ranked.where(F.col("place") <= F.greatest(F.floor(F.col("L") * widen), F.lit(1)))
        if ties:
            edge = kept.groupBy("world").agg(F.min("size").alias("edge"))
            kept = ranked.join(edge, "world").where(F.col("size") >= F.col("edge"))
    counted = kept.join(kept.groupBy("world").agg(F.count("*").alias("qualified")), "world")
    return comps.join(counted.select("world", "comp", "size", "L", "qualified", "rank"), ["world", "comp"]).groupBy("node").agg(F.sum(F.expr(score)).alias("score"))


#: Ways to score a node of a qualified component.
SCORES = {"inverse": "1/size", "one": "1.0", "size": "double(size)", "root": "1/sqrt(size)", "square": "1/(size*size)", "share": "L/size", "shared": "1/(size*L)", "rank": "1/rank", "rank_left": "double(L-rank+1)", "count": "1/qualified"}


def degree_discount_order(arcs: DataFrame, target: float, k: int, p: float = P) -> DataFrame:
    """Prefixes of the degree-discount order; ``target`` does not change the order."""
    return selection.degree_discount(arcs, k, p)


def new_greedy_until(edges: DataFrame, nodes: DataFrame, target: float, most: int, worlds: int, p: Column | float = P) -> DataFrame:
    """(target, k, spread) by new-greedy picks, until their own spread estimate reaches the target."""
    return minimize(edges, selection.new_greedy(edges, nodes, most, worlds, p), [target], worlds, p)

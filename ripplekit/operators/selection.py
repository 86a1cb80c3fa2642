"""Seed selection: the best k nodes. All return seeds (rank from 1, node, score); ties go to the smaller node."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..schema import P, SEED, fires, nodes_of, u01
from ..storage import drop, store
from . import diffusion, worlds as W

SEEDS = "rank int, node long, score double"
#: Nodes whose arcs are packed together, and arcs of a packed row.
BLOCK_NODES, PIECE_ARCS = 256, 1 << 17


def top(scores: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The k best of scores (node, score), found without a full sort."""
    best = scores.select("node", F.round(F.col("score").cast("double"), digits).alias("score")).orderBy(F.desc("score"), "node").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "node")).alias("rank"), "node", "score")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, score): weighted out-degree."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").cast("double").alias("score"))


def top_degree(edges: DataFrame, k: int) -> DataFrame:
    return top(degrees(edges), k)


def random_nodes(nodes: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """k nodes in hash order."""
    best = nodes.select("node", u01(seed, "pick", F.col("node")).alias("score")).orderBy("score", "node").limit(k)
    return best.select(F.row_number().over(Window.orderBy("score", "node")).alias("rank"), "node", "score")


def _greedy(scores: DataFrame, arcs: DataFrame, k: int, score: Column, **change: Column) -> DataFrame:
    """k rounds: take the best node, then change the scores of its neighbours by their arcs.

    scores (node, score, ...); arcs (src, dst, w, ...), both ways if undirected. In a round the arcs of the
    seeds taken so far are aggregated by neighbour (``change``: name and aggregate), and ``score`` makes
    a neighbour's score of these and the columns of scores. Both tables are written to the shared folder
    once, arcs sorted by src in each part, so that a round reads the row groups with seeds; the driver
    gets one row a round and holds k seeds.
    """
    spark = scores.sparkSession
    scores, arcs = store(scores, "scores"), store(arcs.sortWithinPartitions("src"), "arcs")
    taken: list[tuple[int, int, float]] = []
    for rank in range(1, k + 1):
        rows = scores
        if taken:
            chosen = [n for _, n, _ in taken]
            hit = arcs.where(F.col("src").isin(chosen)).groupBy(F.col("dst").alias("node")).agg(*[agg.alias(name) for name, agg in change.items()], F.first(F.lit(True)).alias("_hit"))
            rows = scores.where(~F.col("node").isin(chosen)).join(hit, "node", "left").withColumn("score", F.when(F.col("_hit"), score).otherwise(F.col("score")))
        best = top(rows, 1).collect()
        if not best:
            break
        taken.append((rank, best[0]["node"], best[0]["score"]))
    drop(scores)
    drop(arcs)
    return spark.createDataFrame(taken, SEEDS)


def single_discount(arcs: DataFrame, k: int) -> DataFrame:
    """A neighbour's degree falls by the weight of its edge to a seed."""
    return _greedy(degrees(arcs), arcs, k, F.col("score") - F.col("t"), t=F.sum("w"))


def degree_discount(arcs: DataFrame, k: int, p: float = P) -> DataFrame:
    """Score d - 2t - (d - t) t p, where t counts edges to seeds."""
    d, t = F.col("score"), F.col("t")
    return _greedy(degrees(arcs), arcs, k, d - 2 * t - (d - t) * t * p, t=F.sum("w"))


def degree_discount_star(arcs: DataFrame, k: int, p: float = P) -> DataFrame:
    """Score (1 - p)^t (1 + (d - t) p)."""
    d, t = F.col("d"), F.col("t")
    start = degrees(arcs).select("node", (1 + F.col("score") * p).alias("score"), F.col("score").alias("d"))
    return _greedy(start, arcs, k, F.pow(F.lit(1 - p), t) * (1 + (d - t) * p), t=F.sum("w"))


def general_discount(arcs: DataFrame, k: int) -> DataFrame:
    """Score active * (1 + inactive) on arcs with p: the chance to be inactive still, and the mean of those it activates."""
    start = arcs.groupBy(F.col("src").alias("node")).agg(F.sum(fires("w", F.col("p"))).alias("inactive"))
    score = F.col("active") * (1 + F.col("inactive") - F.col("gone"))
    return _greedy(start.select("node", (1 + F.col("inactive")).alias("score"), "inactive"), arcs, k, score, active=F.product(1 - fires("w", F.col("p"))), gone=F.sum(fires("w", F.col("p"))))


def penalized(scores: DataFrame, arcs: DataFrame, k: int, p: float = P, exponent: float = 1.0) -> DataFrame:
    """Take the best score; neighbours' scores are multiplied by (1 - p)^(exponent * w). Arcs may carry p."""
    chance = F.col("p") if "p" in arcs.columns else F.lit(float(p))
    start = scores.select("node", F.col("score").cast("double").alias("score"))
    return _greedy(start, arcs, k, F.col("score") * F.col("left"), left=F.product(F.pow(1 - chance, exponent * F.col("w"))))


# --- scores from sampled components -------------------------------------------------------------


def _sized(comps: DataFrame) -> DataFrame:
    return comps.join(W.component_sizes(comps), ["world", "comp"])


def _top_components(comps: DataFrame, k: int, ties: bool) -> DataFrame:
    order = Window.partitionBy("world").orderBy(F.desc("size"), *([] if ties else ["comp"]))
    return W.component_sizes(comps).withColumn("place", (F.rank() if ties else F.row_number()).over(order)).where(F.col("place") <= k)


def component_scores(comps: DataFrame, k: int, ties: bool = True) -> DataFrame:
    """(node, score): 1 / size for each world where the node is in one of the k largest components."""
    return comps.join(_top_components(comps, k, ties), ["world", "comp"]).groupBy("node").agg(F.sum(1 / F.col("size")).alias("score"))


def cc_heuristic_scores(comps: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """1/sqrt(size), given with that chance, in the k largest components (no ties)."""
    gain = 1 / F.sqrt("size")
    rows = comps.join(_top_components(comps, k, False), ["world", "comp"]).where(u01(seed, "gain", F.col("world"), F.col("node")) < gain)
    return rows.groupBy("node").agg(F.sum(gain).alias("score"))


def size_scores(comps: DataFrame) -> DataFrame:
    """The sum of the sizes of a node's components."""
    return _sized(comps).groupBy("node").agg(F.sum("size").cast("double").alias("score"))


def reach_scores(reached: DataFrame, k: int) -> DataFrame:
    """(node, score): the sum of reach over worlds where the node is among the k of largest reach, ties included."""
    order = Window.partitionBy("world").orderBy(F.desc("size"))
    return reached.withColumn("place", F.rank().over(order)).where(F.col("place") <= k).groupBy("node").agg(F.sum("size").cast("double").alias("score"))


def component_reach(comps: DataFrame) -> DataFrame:
    return _sized(comps).select("world", "node", "size")


def new_greedy(edges: DataFrame, nodes: DataFrame, k: int, worlds: int, p: Column | float = P, seed: int = SEED) -> DataFrame:
    """Each step samples new worlds; a node gains the mean size of its components that hold no seed yet."""
    taken: list[tuple[int, int, float]] = []
    spark, kernel = edges.sparkSession, W.few(edges) or None
    for step in range(k):
        live = W.live_edges(edges, worlds, p, seed, first=step * worlds)
        comps = W.components(live, kernel=kernel)
        every = nodes.withColumn("world", F.explode(F.sequence(F.lit(step * worlds), F.lit((step + 1) * worlds - 1))))
        comps = every.join(comps, ["world", "node"], "left").select("world", "node", F.coalesce("comp", "node").alias("comp"))
        if taken:
            chosen = spark.createDataFrame([(n,) for _, n, _ in taken], "node long")
            hit = comps.join(F.broadcast(chosen), "node").select("world", "comp").distinct()
            comps = comps.join(hit, ["world", "comp"], "left_anti")
        scores = size_scores(comps).select("node", (F.col("score") / worlds).alias("score"))
        best = top(scores, 1).collect()
        if not best:
            break
        taken.append((step + 1, best[0]["node"], best[0]["score"]))
    return spark.createDataFrame(taken, SEEDS)


def _gain_beyond(seeds: np.ndarray):
    """A kernel: for each node of a world, the nodes it reaches beyond those of the seeds, itself not counted."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = kernels.Arcs(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
        covered = set(np.flatnonzero(kernels.levels(g, g.number(seeds)) >= 0)) if len(seeds) else set()
        return pd.DataFrame({"node": g.names, "gain": [len(s - covered) - (0 if v in covered else 1) for v, s in enumerate(kernels.reach_sets(g))]})

    return run


def _gains_by_joins(live: DataFrame, covered: DataFrame | None) -> DataFrame:
    """(node, gain): the nodes that each reaches, itself not counted, and the seeds' reach doesn't hold."""
    pairs = W.reach_pairs(live, kernel=False).withColumnRenamed("v", "node")
    if covered is not None:
        pairs = pairs.join(covered.select("world", "node"), ["world", "node"], "left_anti")
    return pairs.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("gain"))


def general_greedy(edges: DataFrame, k: int, worlds: int, p: Column | float = P, seed: int = SEED) -> DataFrame:
    """Each step adds the node whose seeds plus it spread furthest over the step's worlds: one job for all candidates.

    Directed reach: a candidate gains the nodes that it reaches and the seeds don't.
    """
    spark, taken, small = edges.sparkSession, [], W.few(edges)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().persist()
    for step in range(k):
        live = W.live_edges(edges, worlds, p, seed, first=step * worlds)
        seeds = np.array([n for _, n, _ in taken], np.int64)

        kernel = small or W.fits(live)
        rest = nodes.join(F.broadcast(spark.createDataFrame([(int(n),) for n in seeds] or [(-1,)], "node long")), "node", "left_anti")
        # a node outside its world's live edges, or not covered, counts itself: 1 in every world but those it is covered in
        base = W.reach(live, spark.createDataFrame([(int(n),) for n in seeds] or [(-1,)], "node long"), worlds, kernel=kernel, first=step * worlds) if len(seeds) else None
        if kernel:
            gains = live.groupBy("world").applyInPandas(_gain_beyond(seeds), "node long, gain long").groupBy("node").agg(F.sum("gain").alias("gain"))
        else:
            gains = _gains_by_joins(live, base)
        own = rest.withColumn("own", F.lit(worlds))
        if base is not None:
            own = rest.join(base.groupBy("node").agg(F.count("*").alias("c")), "node", "left").select("node", (worlds - F.coalesce("c", F.lit(0))).alias("own"))
        scores = own.join(gains, "node", "left").select("node", ((F.col("own") + F.coalesce("gain", F.lit(0))) / worlds).alias("score"))
        best = top(scores, 1).collect()
        if not best:
            break
        taken.append((step + 1, best[0]["node"], best[0]["score"]))
    nodes.unpersist()
    return spark.createDataFrame(taken, SEEDS)


def packed_thresholds(edges: DataFrame, worlds: int, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Stored (node, v), v from 0 by node, and stored rows of packed arrays: of the arcs from BLOCK_NODES nodes, and of
    what each node needs in a world. Weights and needs are whole 10^-12; a need is met by the weight rounded to 9 digits."""
    ids = nodes_of(edges).where(F.col("node").isNotNull())
    nodes = store(ids.select("node", (F.row_number().over(Window.orderBy("node")) - 1).cast("int").alias("v")), "ltnodes")
    x = F.round(F.round(F.col("b") * F.col("w"), 12) * 1e12).cast("long").alias("x")
    arcs = edges.select("src", "dst", x).join(nodes.select(F.col("node").alias("src"), F.col("v").alias("a")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("v").alias("b")), "dst")

    def arrays(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"])
        parts = [pdf.iloc[k : k + PIECE_ARCS] for k in range(0, len(pdf), PIECE_ARCS)]
        rows = [(-1, p["block"].iloc[0], k, p["a"].to_numpy(np.int32).tobytes(), p["b"].to_numpy(np.int32).tobytes(), p["x"].to_numpy(np.int64).tobytes()) for k, p in enumerate(parts)]
        return pd.DataFrame(rows, columns=["world", "block", "piece", "a", "b", "x"])

    def needs(pdf: pd.DataFrame) -> pd.DataFrame:
        theta = pdf.sort_values("node")["threshold"].to_numpy()
        need = np.maximum(np.ceil(theta * 1e9).astype(np.int64) * 1000 - 500, 1)
        return pd.DataFrame([(pdf["world"].iloc[0], 0, 0, b"", b"", need.tobytes())], columns=["world", "block", "piece", "a", "b", "x"])

    kind = "world int, block int, piece int, a binary, b binary, x binary"
    blocks = arcs.select(F.floor(F.col("a") / BLOCK_NODES).cast("int").alias("block"), "a", "b", "x").groupBy("block").applyInPandas(arrays, kind)
    return nodes, store(blocks.unionByName(diffusion.thresholds(nodes, worlds, seed).groupBy("world").applyInPandas(needs, kind)), "ltgraph")


def general_greedy_lt(edges: DataFrame, k: int, worlds: int = 20, seed: int = SEED) -> DataFrame:
    """General greedy under linear thresholds; every step tries each node as the next seed.

    The final set does not depend on the order of activations, so only what a tried node adds is followed. Each
    task reads the whole graph, packed, from the shared folder and tries its part of the nodes in all worlds; the
    driver gets one row a task.
    """
    spark = edges.sparkSession
    nodes, graph = packed_thresholds(edges, worlds, seed)
    n, parts = nodes.count(), 2 * spark.sparkContext.defaultParallelism
    taken: list[tuple[int, int, float]] = []  # rank, number, score
    whole = graph.coalesce(1).rdd
    copies = spark.sparkContext.union([whole] * parts)  # a partition for each part
    for step in range(k if n else 0):
        held = np.array([v for _, v, _ in taken], np.int64)

        def run(part, rows, held=held):
            pieces, needs, size = [], [], np.zeros(n + 1, np.int64)
            for r in rows:
                if r.world >= 0:
                    needs.append(np.frombuffer(r.x, np.int64))
                else:
                    a = np.frombuffer(r.a, np.int32)
                    size[a[0] + 1 : a[-1] + 2] += np.bincount(a - a[0])
                    pieces.append((r.block, r.piece, np.frombuffer(r.b, np.int32), np.frombuffer(r.x, np.int64)))
            pieces.sort(key=lambda p: p[:2])
            g = kernels.Arcs.packed(np.cumsum(size), *[np.concatenate([p[i] for p in pieces]) for i in (2, 3)])
            del pieces
            tried = np.setdiff1d(np.arange(part, n, parts), held)
            if len(tried):
                total = sum(kernels.nested_spreads(g, need, held, tried) for need in needs)
                best = int(np.argmax(total))
                yield int(tried[best]), float(total[best] / len(needs))

        tried = copies.mapPartitionsWithIndex(run).collect()
        if not tried:
            break
        v, score = min(tried, key=lambda t: (-t[1], t[0]))
        taken.append((step + 1, v, score))
    name = {r["v"]: r["node"] for r in nodes.where(F.col("v").isin([v for _, v, _ in taken])).collect()}
    drop(nodes)
    drop(graph)
    return spark.createDataFrame([(rank, name[v], score) for rank, v, score in taken], SEEDS)


def representative_nodes(arcs: DataFrame, k: int, metric: int = 1) -> DataFrame:
    """Start from the two ends of the heaviest edge; add the node with the greatest sum (1) or minimum (2) of
    edge weights to the seeds. Without edges to any seed a node is out; a first edge sets its minimum."""
    spark = arcs.sparkSession
    start = arcs.where("src < dst").orderBy(F.desc("w"), "src", "dst").limit(1).collect()
    if not start:
        return spark.createDataFrame([], SEEDS)
    arcs = arcs.persist()
    taken = [(1, start[0]["src"], float(start[0]["w"])), (2, start[0]["dst"], float(start[0]["w"]))][:k]
    while len(taken) < k:
        chosen = F.broadcast(spark.createDataFrame([(n,) for _, n, _ in taken], "src long"))
        near = arcs.join(chosen, "src").join(chosen.select(F.col("src").alias("dst")), "dst", "left_anti")
        how = F.sum("w") if metric == 1 else F.min("w")
        best = top(near.groupBy(F.col("dst").alias("node")).agg(how.cast("double").alias("score")), 1).collect()
        if not best:
            break
        taken.append((len(taken) + 1, best[0]["node"], best[0]["score"]))
    arcs.unpersist()
    return spark.createDataFrame(taken, SEEDS)


def brute_force(edges: DataFrame, candidates: DataFrame, k: int, worlds: int, p: Column | float = P, seed: int = SEED) -> DataFrame:
    """(nodes, spread) of the best set of k candidates; all sets are tried on one job's worlds. For small graphs."""
    sets = candidates.select(F.array("node").alias("nodes"))
    for _ in range(k - 1):
        more = candidates.select(F.col("node").alias("n"))
        sets = sets.join(more, F.col("n") > F.element_at("nodes", -1)).select(F.concat("nodes", F.array("n")).alias("nodes"))
    rows = sets.withColumn("set", F.concat_ws(",", F.transform("nodes", lambda x: x.cast("string"))))
    spread = diffusion.spread_of_sets(edges, rows.select("set", F.explode("nodes").alias("node")), worlds, p, seed)
    return spread.orderBy(F.desc("spread"), "set").limit(1)


def degree_inside(edges: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Top k by degree counted inside a node set only."""
    m = members.select("node").distinct()
    inside = edges.join(m.select(F.col("node").alias("src")), "src", "left_semi").join(m.select(F.col("node").alias("dst")), "dst", "left_semi")
    return top_degree(inside, k)


# --- sequential scorers: one pass over worlds in order, in one task ------------------------------


def continuous_search(comps: DataFrame, arcs: DataFrame, k: int, p: float = P, seed: int = SEED) -> DataFrame:
    """World after world, one node of each of the k largest components is credited: its best so far.

    Of components that tie at rank k one, by hash, is credited. The last step is the penalized pick.
    Scores depend on the order of worlds, so they are summed in one task, from top-k components only.
    """
    order = Window.partitionBy("world").orderBy(F.desc("size"), u01(seed, "tie", F.col("world"), F.col("comp")), "comp")
    best = W.component_sizes(comps).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    rows = comps.join(best, ["world", "comp"]).select("world", "place", "node", "size", F.lit(0).alias("one"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        score: dict[int, float] = {}
        for _, part in pdf.sort_values(["world", "place", "node"]).groupby(["world", "place"], sort=True):
            node = min(part["node"], key=lambda n: (-score.get(n, 0.0), n))
            score[node] = score.get(node, 0.0) + 1.0
        return pd.DataFrame({"node": list(score), "score": list(score.values())})

    scores = rows.groupBy("one").applyInPandas(run, "node long, score double")
    return penalized(scores, arcs, k, p)


def directed_harvest_scores(live: DataFrame, k: int) -> DataFrame:
    """(node, score) by the directed rule, summed over worlds.

    In a world, M(x) = 1 / (nodes that reach x), 0 if none. Nodes are scanned by reach, largest first, and
    each gains the sum of M over what it reaches; the scan stops when k scanned nodes were out of the
    reach of those before, and goes on through ties with the last.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = kernels.Arcs(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
        out = [s - {v} for v, s in enumerate(kernels.reach_sets(g))]
        into = np.zeros(g.n)
        for s in out:
            into[list(s)] += 1
        m = np.where(into > 0, 1 / np.maximum(into, 1), 0)
        order = sorted(range(g.n), key=lambda v: (-len(out[v]), g.names[v]))
        marked, free, last, rows = set(), 0, None, []
        for v in order:
            if free >= k and len(out[v]) != last:
                break
            rows.append((g.names[v], float(sum(m[u] for u in sorted(out[v])))))
            if free < k:
                last = len(out[v])
                if v not in marked:
                    free += 1
                    marked |= out[v] | {v}
        return pd.DataFrame(rows, columns=["node", "score"])

    return live.groupBy("world").applyInPandas(run, "node long, score double").groupBy("node").agg(F.sum("score").alias("score"))

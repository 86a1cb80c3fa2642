"""One query for each operator, on graphs derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as H
from ..operators import diffusion as D
from ..operators import local_trees as T
from ..operators import minimize as Z
from ..operators import models as M
from ..operators import reliability as R
from ..operators import selection as K
from ..operators import sparsify as X
from ..operators import transforms as E
from ..operators import worlds as W
from ..schema import both_ways, event_graph, nation_graph, nodes_of, uncertain, undirected
from ..sources import readers as S
from ..sources import writers as O
from ..storage import new_path, store

WORLDS, SEEDS_K, P = 20, 5, 0.01
TARGETS = [12.0, 56.0]
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


class Graphs:
    """The graphs of a folder of tables, made when first used; the event graph is stored once per query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        make = {
            "arcs": lambda: store(event_graph(self.spark, self.dir), "arcs"),
            "und": lambda: undirected(self.arcs),
            "sym": lambda: both_ways(self.und),
            "nodes": lambda: nodes_of(self.arcs),
            "unodes": lambda: nodes_of(self.und),
            "arcs_p": lambda: M.multivalency(self.arcs),
            "sym_p": lambda: M.multivalency(self.sym, directed=False),
            "nation": lambda: store(undirected(nation_graph(self.spark, self.dir)).withColumn("w", F.lit(1).cast("long")), "nation"),
            "sure": lambda: uncertain(self.nation),
            "faint": lambda: uncertain(self.nation, 0.01, 0.14),
            "seeds": lambda: K.top_degree(self.arcs, SEEDS_K),
            "useeds": lambda: K.top_degree(self.sym, SEEDS_K),
            "live": lambda: W.live_edges(self.arcs, WORLDS, P),
            "ulive": lambda: W.live_edges(self.und, WORLDS, P),
            "comps": lambda: W.components(self.ulive, self.unodes, WORLDS),
        }.get(name)
        if make is None:
            raise AttributeError(name)
        value = make()
        setattr(self, name, value)
        return value

    def path(self, name: str) -> str:
        return new_path(self.spark, name)


def graphs(f):
    """A query over Graphs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(Graphs(spark, sf_dir))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return query(run)


# --- sources and sinks ---------------------------------------------------------------------------


@graphs
def s01_multigraph_reader(g):
    return S.read_multigraph(g.spark, O.write_multigraph(g.und, g.path("s01")))


@graphs
def s02_both_ways_reader(g):
    return S.read_multigraph(g.spark, O.write_multigraph(g.und, g.path("s02")), directed=True)


@graphs
def s03_weighted_reader(g):
    lines = g.arcs.select("src", "dst", F.explode(F.sequence(F.lit(1), F.col("w"))))
    lines.select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(path := g.path("s03"))
    return S.read_weighted(g.spark, path)


@graphs
def s04_unweighted_reader(g):
    return S.read_unweighted(g.spark, O.write_lines(g.arcs, g.path("s04"), "src", "dst"), directed=True)


@graphs
def s05_undirected_to_directed(g):
    return S.to_directed(g.und)


@graphs
def s06_adjacency_reader(g):
    n = g.nodes.agg(F.max("node")).head()[0] + 1
    return S.read_adjacency(g.spark, O.write_adjacency(g.arcs, n, g.path("s06")))


@graphs
def s07_remap_ids(g):
    return S.remap(g.und, g.unodes.select(F.col("node").alias("old"), (1_000_000 - F.col("node") * 7).alias("new")))


@graphs
def s08_uncertain_reader(g):
    rows = g.arcs_p.select("src", "dst", "p").where("src <= dst")
    return rounded(S.read_uncertain(g.spark, O.write_lines(rows, g.path("s08"), "src", "dst", "p"), directed=True), "cost")


@graphs
def s09_edge_probability_reader(g):
    return S.attach_probabilities(g.spark, g.arcs, O.write_lines(g.arcs_p, g.path("s09"), "src", "dst", "p"))


@graphs
def s10_stored_graph(g):
    edges, nodes = S.read_parquet_graph(g.spark, O.write_graph(g.arcs, g.nodes, g.path("s10")))
    return nodes.join(edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("w")), "node", "left")


@graphs
def s11_reliability_reader(g):
    return S.read_reliability(g.spark, O.write_lines(g.faint.select("src", "dst", "p"), g.path("s11"), "src", "dst", "p"))


@graphs
def s12_named_reader(g):
    named = g.faint.select(F.concat(F.lit("n"), "dst").alias("a"), F.concat(F.lit("n"), "src").alias("b"), "p")
    return S.read_named(g.spark, O.write_lines(named, g.path("s12"), "a", "b", "p"))


@query
def s13_random_graph(spark, sf_dir):
    return S.random_graph(spark, 60, 200)


@graphs
def s14_truncated_normal(g):
    return rounded(S.truncated_normal(g.und.select("src", "dst")), "p")


@graphs
def s15_seed_lists(g):
    sets = g.seeds.select(F.lit(0).cast("long").alias("set"), "rank", "node").unionByName(g.useeds.select(F.lit(1).cast("long").alias("set"), "rank", "node"))
    return S.read_seeds_json(g.spark, O.write_seeds_json(sets, g.path("s15")))


@graphs
def s16_seed_lines(g):
    return g.spark.read.schema("node string").text(O.write_seeds(g.seeds, g.path("s16"))).select(F.col("node").cast("long").alias("node"))


@graphs
def s17_result_sink(g):
    sizes = g.live.groupBy("world").agg(F.count("*").alias("n"))
    path = O.append_results(sizes.where("world < 10"), g.path("s17"), "world", "n")
    O.append_results(sizes.where("world >= 10"), path, "world", "n")
    return S.read_results(g.spark, path, "world", "n")


@graphs
def s18_result_reader(g):
    curve = D.spread_by_worlds(D.cascade(g.arcs, g.seeds, WORLDS), WORLDS)
    return rounded(S.read_results(g.spark, O.append_results(curve, g.path("s18"), "r", "spread"), "r", "spread"), "spread")


@graphs
def s19_world_sink(g):
    return g.spark.read.parquet(O.write_worlds(g.live, g.path("s19"))).groupBy("world").agg(F.count("*").alias("n"), F.sum("src").alias("s"), F.sum("dst").alias("d"))


@graphs
def s20_lp_export(g):
    m = O.lp_matrix(g.faint, X.expected_degrees(g.faint))
    return rounded(m["A"].join(m["d"], "row").join(m["edges"], "col").select("row", "col", "value", "d", "src", "dst"), "d")


@graphs
def s21_lp_export_directed(g):
    d = X.expected_degrees(g.faint, directed=True)
    m = O.lp_matrices_directed(g.faint, d.select("node", F.col("dout").alias("d")), d.select("node", F.col("din").alias("d")))
    rows = None
    for side in ("out", "in"):
        part = m[f"A{side}"].join(m[f"d{side}"], "row").select(F.lit(side).alias("side"), "row", "col", "value", "d")
        rows = part if rows is None else rows.unionByName(part)
    return rounded(rows, "d")


@graphs
def s22_lp_solution(g):
    edges = O.lp_matrix(g.faint, X.expected_degrees(g.faint))["edges"]
    return O.zip_solution(edges.select("col", F.round(F.col("col") / 1000, 6).alias("x")), edges)


# --- transforms ----------------------------------------------------------------------------------


def _lines(g) -> DataFrame:
    """The events' arcs in a fixed order of lines."""
    from pyspark.sql import Window

    return g.arcs.select((F.row_number().over(Window.orderBy(F.desc("w"), "src", "dst")) - 1).cast("long").alias("line"), "src", "dst")


def _actions(g) -> DataFrame:
    ev = g.spark.read.parquet(f"{g.dir}/events.parquet")
    return ev.select(F.when(F.col("event_id") % 3 != 0, F.col("user_id") + 1).alias("src"), F.col("user_id").alias("dst"), F.col("event_id").alias("action"))


@graphs
def e01_clean_graph(g):
    return E.clean_graph(_lines(g))


@graphs
def e02_relabel_actions(g):
    return E.relabel_actions(_lines(g), _actions(g))[1]


@graphs
def e03_prune(g):
    return E.prune(_lines(g), 40).select("src", "dst")


@graphs
def e04_diameters(g):
    live = W.live_edges(g.und, 1, 0.02)
    return E.diameters(live.select("src", "dst"), W.components(live))


@graphs
def e05_almost_equal(g):
    return g.arcs_p.select("src", "dst", E.almost_equal(F.col("p"), F.lit(0.02), 0.011).alias("equal"))


@graphs
def e06_ego_edges(g):
    live = W.live_edges(g.und, 1, 0.02).select("src", "dst").withColumn("w", F.lit(1).cast("long"))
    return E.ego_edges(both_ways(live), g.useeds, 2)


@graphs
def e07_spread_edges(g):
    active = D.cascade(g.arcs, g.seeds, 1).select("node", "level")
    return E.spread_edges(g.arcs, active)


@graphs
def e08_mean_probability(g):
    return rounded(E.mean_probability(g.arcs_p), "p")


@graphs
def e09_percentage_difference(g):
    a = D.spread_by_worlds(D.cascade(g.arcs, g.seeds, WORLDS), WORLDS).select(F.col("r").alias("k"), F.col("spread").alias("y"))
    b = D.spread_by_worlds(D.cascade(g.arcs, g.seeds, WORLDS, 0.02), WORLDS).select(F.col("r").alias("k"), F.col("spread").alias("y"))
    return rounded(E.percentage_difference(a, b), "difference")


# --- models --------------------------------------------------------------------------------------


@graphs
def m01_uniform(g):
    return M.uniform(g.arcs, 0.01)


@graphs
def m02_multivalency(g):
    return M.multivalency(g.sym, directed=False)


@graphs
def m03_random(g):
    return rounded(M.random(g.arcs, 0.1), "p")


@graphs
def m04_weighted_cascade(g):
    return rounded(M.weighted_cascade(g.arcs), "p")


@graphs
def m05_degree_categories(g):
    return M.degree_categories(g.arcs)


@graphs
def m06_uniform_weights(g):
    return rounded(M.uniform_weights(g.arcs), "b")


@graphs
def m07_random_weights(g):
    return rounded(M.random_weights(g.arcs), "b")


@graphs
def m08_lt_check(g):
    return rounded(M.overweight(g.arcs.withColumn("b", F.lit(1 / 60))), "total")


@graphs
def m09_triangular(g):
    return rounded(M.triangular(g.arcs, 0.0, 0.02, 0.1), "p")


# --- diffusion -----------------------------------------------------------------------------------


@graphs
def d01_cascade(g):
    return D.cascade(g.arcs, g.seeds, WORLDS).select("world", "node")


@graphs
def d02_cascade_levels(g):
    return D.cascade(g.arcs, g.seeds, WORLDS)


@graphs
def d03_mean_size(g):
    return rounded(D.mean_spread(D.cascade(g.und, g.useeds, WORLDS, undirected=True), WORLDS), "spread")


@graphs
def d04_arc_cascade(g):
    return D.cascade(g.arcs_p, g.seeds, WORLDS, F.col("p") / 4).select("world", "node")


@graphs
def d05_expected_spread(g):
    """The expected spread of the five nodes of greatest degree in the event graph."""
    return rounded(D.mean_spread(D.cascade(g.arcs, g.seeds, WORLDS), WORLDS), "spread")


@graphs
def d06_linear_threshold(g):
    return D.linear_threshold(M.uniform_weights(g.arcs), g.seeds, WORLDS)


@graphs
def d07_mean_linear_threshold(g):
    return rounded(D.mean_spread(D.linear_threshold(M.uniform_weights(g.arcs), g.seeds, WORLDS), WORLDS), "spread")


@graphs
def d08_spread_curve(g):
    return rounded(D.spread_curve(g.arcs, g.seeds, WORLDS), "spread")


@graphs
def d09_spread_by_worlds(g):
    return rounded(D.spread_by_worlds(D.cascade(g.arcs, g.seeds, WORLDS), WORLDS), "spread")


@graphs
def d10_spread_of_sets(g):
    sets = g.seeds.select(F.lit("out").alias("set"), "node").unionByName(g.nodes.where("node % 20 = 0").select(F.lit("twenties").alias("set"), "node"))
    return rounded(D.spread_of_sets(g.arcs, sets, WORLDS), "spread")


# --- worlds --------------------------------------------------------------------------------------


@graphs
def w01_live_edges(g):
    return g.live


@graphs
def w02_components(g):
    return g.comps


@graphs
def w03_component_reach(g):
    return K.component_reach(g.comps)


@graphs
def w04_strong_components(g):
    return W.strong_components(W.live_edges(g.arcs, 5, 0.02))


@graphs
def w05_condensation(g):
    live = W.live_edges(g.arcs, 5, 0.02)
    return W.condensation(live, W.strong_components(live))


@graphs
def w06_reach_topsort(g):
    return W.reach_sizes(W.live_edges(g.arcs, 5, 0.02), "topsort")


@graphs
def w07_reach_bfs(g):
    return W.reach_sizes(W.live_edges(g.arcs, 5, 0.02), "bfs")


@graphs
def w08_multihop_neighbours(g):
    return W.reach_pairs(W.live_edges(g.arcs, 5, P))


@graphs
def w09_one_hop(g):
    return W.one_hop(g.live, g.seeds)


@graphs
def w10_components_for_target(g):
    return W.components_for_target(g.comps, 40)


@graphs
def w11_size_histogram(g):
    return W.size_histogram(g.comps, 20)


@graphs
def w12_components_for_targets(g):
    return W.components_for_targets(g.comps, [10, 30, 60, 100])


@graphs
def w13_greedy_world(g):
    return X.greedy_world(g.faint)


@graphs
def w14_rewired_world(g):
    return X.rewired_world(g.faint)


@graphs
def w15_matched_world(g):
    return X.matched_world(g.faint)


@graphs
def w16_forest_world(g):
    return X.forest_world(g.faint)


@graphs
def w17_components_by_joins(g):
    """w02's labels by the relational form for worlds that exceed a task."""
    return W.components(g.ulive, g.unodes, WORLDS, kernel=False)


@graphs
def w18_reach_by_joins(g):
    """d02's activations by the relational form."""
    return W.reach(W.live_edges(g.arcs, 5, P), g.seeds, 5, kernel=False)


# --- selection -----------------------------------------------------------------------------------


@graphs
def k01_top_degree(g):
    return g.seeds


@graphs
def k02_random_nodes(g):
    return rounded(K.random_nodes(g.nodes, 5), "score")


@graphs
def k03_single_discount(g):
    return K.single_discount(g.sym, 4)


@graphs
def k04_degree_discount(g):
    return rounded(K.degree_discount(g.sym, 4), "score")


@graphs
def k05_degree_discount_star(g):
    return rounded(K.degree_discount_star(g.sym, 4), "score")


@graphs
def k06_general_discount(g):
    return rounded(K.general_discount(g.sym_p, 4), "score")


@graphs
def k07_general_greedy(g):
    return rounded(K.general_greedy(g.arcs, 2, WORLDS), "score")


@graphs
def k08_general_greedy_lt(g):
    return rounded(K.general_greedy_lt(M.uniform_weights(g.arcs), 2, 10), "score")


@graphs
def k09_new_greedy(g):
    return rounded(K.new_greedy(g.und, g.unodes, 3, WORLDS), "score")


@graphs
def k10_cc_heuristic(g):
    return rounded(K.top(K.cc_heuristic_scores(g.comps, 10), 5), "score")


@graphs
def k11_cc_ties(g):
    return rounded(K.top(K.component_scores(g.comps, 5), 5), "score")


@graphs
def k12_size_heuristic(g):
    return rounded(K.top(K.size_scores(g.comps), 5), "score")


@graphs
def k13_continuous_search(g):
    return rounded(K.continuous_search(g.comps, g.sym, 4), "score")


@graphs
def k14_ccwp(g):
    comps = W.components(W.live_edges(M.multivalency(g.und, directed=False), WORLDS, F.col("p") / 4), g.unodes, WORLDS)
    return rounded(K.top(K.component_scores(comps, 5), 5), "score")


@graphs
def k15_reach_scores(g):
    return K.reach_scores(K.component_reach(g.comps), 10)


@graphs
def k16_harvester_directed(g):
    return K.top(K.reach_scores(W.reach_sizes(g.live), 10), 5)


@graphs
def k17_harvester_undirected(g):
    return K.top(K.reach_scores(K.component_reach(g.comps), 10), 5)


@graphs
def k18_harvester(g):
    return rounded(K.penalized(K.component_scores(g.comps, 5), g.sym, 3), "score")


@graphs
def k18b_harvester_directed(g):
    return rounded(K.penalized(K.directed_harvest_scores(g.live, 5), g.arcs, 3), "score")


@graphs
def k19_penalized(g):
    return rounded(K.penalized(K.degrees(g.sym), g.sym, 4, 0.05), "score")


@graphs
def k20_representative_sum(g):
    return K.representative_nodes(g.sym, 4, 1)


@graphs
def k20b_representative_min(g):
    return K.representative_nodes(g.sym, 4, 2)


@graphs
def k21_pmia(g):
    return rounded(T.pmia(M.weighted_cascade(g.arcs.where("src <> dst")), 4), "score")


@graphs
def k22_ldag(g):
    return rounded(T.ldag(M.uniform_weights(g.arcs.where("src <> dst")), 4, 1 / 40), "score")


@graphs
def k23_brute_force(g):
    return rounded(K.brute_force(g.arcs, K.top_degree(g.arcs, 8).select("node"), 2, WORLDS), "spread")


@graphs
def k24_degree_inside(g):
    return K.degree_inside(g.sym, g.unodes.where("node % 2 = 0"), 5)


# --- minimization --------------------------------------------------------------------------------


def _fewest(g, seeds: DataFrame) -> DataFrame:
    return rounded(Z.minimize(g.und, seeds, TARGETS, WORLDS), "spread")


@graphs
def z01_degree_discount(g):
    return _fewest(g, K.degree_discount(g.sym, 6))


@graphs
def z02_step_and_bisect(g):
    curve = D.spread_curve(g.und, K.degree_discount(g.sym, 6), WORLDS, undirected=True)
    return Z.search_steps(curve, TARGETS)


@graphs
def z03_stop_at_target(g):
    return Z.minimize(g.und, K.degree_discount(g.sym, 6), TARGETS[:1], WORLDS).select("target", "k")


@graphs
def z04_new_greedy(g):
    return rounded(Z.new_greedy_until(g.und, g.unodes, TARGETS[0], 3, WORLDS), "spread")


@graphs
def z05_reverse_ccwp(g):
    return _fewest(g, K.penalized(Z.reverse_scores(g.comps, 40, 2.3), g.sym, 5))


@graphs
def z06_reverse_ccwp_least(g):
    return _fewest(g, K.penalized(Z.reverse_scores(g.comps, 40, least=3), g.sym, 5))


@graphs
def z07_reverse_ccwp_arcs(g):
    scores = Z.reverse_scores(g.comps, 40, least=3, score="1/(size*qualified)")
    return _fewest(g, K.penalized(scores, g.sym_p, 5, exponent=2.0))


@graphs
def z08_reverse_harvester(g):
    return _fewest(g, K.penalized(Z.reverse_scores(g.comps, 40, ties=True, score="1/size"), g.sym, 5))


@graphs
def z09_reverse_general_discount(g):
    return _fewest(g, K.general_discount(g.sym_p, 6))


@graphs
def z10_reverse_pmia(g):
    return _fewest(g, T.pmia(M.weighted_cascade(g.sym), 4))


@graphs
def z11_reverse_degree(g):
    return _fewest(g, K.top_degree(g.sym, 6))


@graphs
def z12_reverse_random(g):
    return _fewest(g, K.random_nodes(g.unodes, 8))


# --- reliability and sparsification --------------------------------------------------------------


def _degrees(g) -> DataFrame:
    """Expected degrees, free of summation order."""
    return X.expected_degrees(g.faint).withColumn("d", F.round("d", 9))


def _pairs(g, n: int = 40) -> DataFrame:
    return R.random_pairs(nodes_of(g.nation), n).select("u", "v")


@graphs
def r01_spanning_forest(g):
    return R.spanning_forest(g.sure)


@graphs
def r02_tree_reliability(g):
    return rounded(R.tree_reliability(R.spanning_forest(g.sure), _pairs(g)), "r")


@graphs
def r03_forest_reliability(g):
    return rounded(R.tree_reliability(R.forests(g.faint), _pairs(g, 20)), "r")


@graphs
def r04_mc_reliability(g):
    return rounded(R.sampled_reliability(g.faint, WORLDS, cutoff=2), "r")


@graphs
def r04b_mc_reliability_pairs(g):
    return rounded(R.sampled_reliability(g.faint, WORLDS, _pairs(g)), "r")


@graphs
def r05_world_reliability(g):
    return R.world_reliability(W.live_edges(g.faint, 1, F.col("p")).select("src", "dst"), _pairs(g))


@graphs
def r06_discrepancy(g):
    pairs = _pairs(g, 60)
    a = R.sampled_reliability(g.faint, WORLDS, pairs)
    b = R.world_reliability(W.live_edges(g.faint, 1, F.col("p")).select("src", "dst"), pairs.where("u % 2 = 0"))
    return rounded(R.discrepancy(a, b), "total", "mean")


@graphs
def r07_random_pairs(g):
    return _pairs(g)


@graphs
def r08_error_curve(g):
    return rounded(R.error_curve(g.faint, 0, 5, 0.5, WORLDS), "error")


@graphs
def r09_forest_order(g):
    return X.forest_order(g.faint, 60)


@graphs
def r10_coin_rounds(g):
    return X.coin_rounds(g.faint, 60)


@graphs
def r11_top_probable(g):
    return X.top_probable(g.faint, 60)


@graphs
def r12_random_edges(g):
    return X.random_edges(g.faint, 60)


@graphs
def r13_relevance_desc(g):
    return rounded(X.relevance(g.faint, R.sampled_reliability(g.faint, WORLDS), 40), "score")


@graphs
def r13b_relevance_asc(g):
    return rounded(X.relevance(g.faint, R.sampled_reliability(g.faint, WORLDS), 40, False), "score")


@graphs
def r14_shortest_paths(g):
    return X.shortest_path_edges(g.sure, 40)


@graphs
def r15_forest_plus(g):
    return X.forest_plus(g.sure, 40)


@graphs
def r15b_forest_leaves(g):
    return X.forest_plus(g.sure, 15, "leaves")


@graphs
def r16_forest_power(g):
    return X.forest_plus(g.sure, 15, "power")


@graphs
def r16b_forest_power_plus(g):
    return X.forest_plus(g.sure, 40, "power")


@graphs
def r17_greedy_degree_loss(g):
    return rounded(X.greedy_degree_loss(g.faint, 20), "p")


@graphs
def r18_chung_lu(g):
    return rounded(X.chung_lu(g.faint), "p")


@graphs
def r19_expected_degrees(g):
    both = X.expected_degrees(g.faint).join(X.expected_degrees(g.faint, directed=True), "node")
    return rounded(both, "d", "dout", "din")


@graphs
def r20_reassign_chung_lu(g):
    return rounded(X.reassign_chung_lu(both_ways(X.top_probable(g.faint, 60)), _degrees(g)), "p")


@graphs
def r21_reassign_equally(g):
    return rounded(X.reassign_equally(both_ways(X.top_probable(g.faint, 60)), _degrees(g)), "p")


@graphs
def r22_redistribute(g):
    return rounded(X.redistribute(g.faint, X.top_probable(g.faint, 60)), "p")


@graphs
def r23_fill_degrees(g):
    kept = X.top_probable(g.faint, 60)
    solved = X.fill_degrees(kept, X.expected_degrees(g.faint))
    return rounded(X.degree_error(solved, X.expected_degrees(g.faint)), "mae")


@graphs
def r23b_degree_error(g):
    return rounded(X.degree_error(X.top_probable(g.faint, 60), X.expected_degrees(g.faint)), "mae")


# --- statistics ----------------------------------------------------------------------------------


@graphs
def h01_pop_order(g):
    return K.top(K.degrees(g.arcs), 20)


@graphs
def h02_defaults(g):
    return rounded(g.arcs.groupBy("src").agg(H.mean_or_zero(F.when(F.col("w") > 2, F.col("w"))).alias("mean"), H.min_or_infinity(F.when(F.col("w") > 1, F.col("w"))).alias("least")), "mean")


@graphs
def h03_by_value(g):
    return H.by_value(K.degrees(g.arcs), descending=False)


@graphs
def h04_timed(g):
    seconds: dict[str, float] = {}
    with H.timed(seconds, "count"):
        n = g.arcs.count()
    return g.spark.createDataFrame([("count", seconds["count"] > 0, n)], "block string, timed boolean, n long")


@graphs
def h05_flatten(g):
    lists = g.arcs.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("to")).groupBy((F.col("src") % 5).alias("part"))
    return lists.agg(F.size(F.flatten(F.collect_list("to"))).cast("long").alias("n"))


@graphs
def h06_graph_statistics(g):
    return rounded(H.graph_statistics(g.und), "mean_degree", "clustering")


@graphs
def h07_summary(g):
    sizes = D.cascade(g.arcs, g.seeds, WORLDS).groupBy("world").agg(F.count("*").alias("n"))
    return rounded(H.summary(sizes, "n"), "mean", "std", "median")


@graphs
def h08_plot_series(g):
    curves = {"p=.01": D.spread_curve(g.arcs, g.seeds, WORLDS), "p=.02": D.spread_curve(g.arcs, g.seeds, WORLDS, 0.02)}
    return rounded(H.series(curves, "k", "spread"), "y")

"""DuckDB SQL of the queries, put together from named blocks."""

from __future__ import annotations

R = 20  # worlds


def u(*parts: str) -> str:
    """The uniform coin; parts are SQL: quoted constants or columns."""
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {', '.join(f'({p})::VARCHAR' for p in parts)})), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


LEVEL = "[0.01, 0.02, 0.04, 0.08]::DOUBLE[]"
COIN = u("42", "world", "src", "dst")
#: name -> (blocks that it needs, SQL)
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    "arcs": ((), "SELECT src, dst, count(*)::BIGINT AS w FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY src, dst"),
    "und": (("arcs",), "SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(w)::BIGINT AS w FROM arcs WHERE src <> dst GROUP BY 1, 2"),
    "sym": (("und",), "SELECT src, dst, w FROM und UNION ALL SELECT dst, src, w FROM und"),
    "nodes": (("arcs",), "SELECT src AS node FROM arcs UNION SELECT dst FROM arcs"),
    "unodes": (("und",), "SELECT src AS node FROM und UNION SELECT dst FROM und"),
    "arcs_p": (("arcs",), f"SELECT src, dst, w, list_extract({LEVEL}, (floor({u('42', chr(39) + 'ep' + chr(39), 'src', 'dst')} * 4) + 1)::INT) AS p FROM arcs"),
    "sym_p": (("sym",), f"SELECT src, dst, w, list_extract({LEVEL}, (floor({u('42', chr(39) + 'ep' + chr(39), 'least(src, dst)', 'greatest(src, dst)')} * 4) + 1)::INT) AS p FROM sym"),
    "nation0": ((), "SELECT least(c_nationkey, s_nationkey)::BIGINT AS src, greatest(c_nationkey, s_nationkey)::BIGINT AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2"),
    "nation_": (("nation0",), "SELECT src, dst, 1::BIGINT AS w FROM nation0"),
    "nnodes": (("nation0",), "SELECT src AS node FROM nation0 UNION SELECT dst FROM nation0"),
    "sure": (("nation_",), f"SELECT src, dst, w, round(0.05::DOUBLE + 0.9::DOUBLE * {u('42', chr(39) + 'ug' + chr(39), 'src', 'dst')}, 6) AS p FROM nation_"),
    "faint": (("nation_",), f"SELECT src, dst, w, round(0.01::DOUBLE + 0.14::DOUBLE * {u('42', chr(39) + 'ug' + chr(39), 'src', 'dst')}, 6) AS p FROM nation_"),
    "seeds": (("arcs",), "SELECT (row_number() OVER (ORDER BY score DESC, node))::INT AS rank, node, score FROM (SELECT src AS node, sum(w)::DOUBLE AS score FROM arcs GROUP BY 1) ORDER BY score DESC, node LIMIT 5"),
    "useeds": (("sym",), "SELECT (row_number() OVER (ORDER BY score DESC, node))::INT AS rank, node, score FROM (SELECT src AS node, sum(w)::DOUBLE AS score FROM sym GROUP BY 1) ORDER BY score DESC, node LIMIT 5"),
    "live": (("arcs",), f"SELECT world::INT AS world, src, dst FROM arcs, range(0, {R}) r(world) WHERE {COIN} <= 1 - pow(1 - 0.01::DOUBLE, w)"),
    "live2": (("arcs",), f"SELECT world::INT AS world, src, dst FROM arcs, range(0, {R}) r(world) WHERE {COIN} <= 1 - pow(1 - 0.02::DOUBLE, w)"),
    "ulive": (("und",), f"SELECT world::INT AS world, src, dst FROM und, range(0, {R}) r(world) WHERE {COIN} <= 1 - pow(1 - 0.01::DOUBLE, w)"),
    "ulive_both": (("ulive",), "SELECT world, src, dst FROM ulive UNION ALL SELECT world, dst, src FROM ulive"),
    "reach": (("live", "seeds"), f"SELECT world::INT AS world, node FROM seeds, range(0, {R}) r(world) UNION SELECT l.world, l.dst FROM reach JOIN live l ON l.world = reach.world AND l.src = reach.node"),
    "reach2": (("live2", "seeds"), f"SELECT world::INT AS world, node FROM seeds, range(0, {R}) r(world) UNION SELECT l.world, l.dst FROM reach2 JOIN live2 l ON l.world = reach2.world AND l.src = reach2.node"),
    "hops": (("live", "seeds"), f"SELECT world::INT AS world, node, 0 AS level FROM seeds, range(0, {R}) r(world) UNION SELECT l.world, l.dst, hops.level + 1 FROM hops JOIN live l ON l.world = hops.world AND l.src = hops.node WHERE hops.level < 40"),
    "levels": (("hops",), "SELECT world, node, min(level)::INT AS level FROM hops GROUP BY 1, 2"),
    "ranks": (("live", "seeds"), f"SELECT world::INT AS world, node, rank::BIGINT AS rank FROM seeds, range(0, {R}) r(world) UNION SELECT l.world, l.dst, ranks.rank FROM ranks JOIN live l ON l.world = ranks.world AND l.src = ranks.node"),
    "ranks2": (("live2", "seeds"), f"SELECT world::INT AS world, node, rank::BIGINT AS rank FROM seeds, range(0, {R}) r(world) UNION SELECT l.world, l.dst, ranks2.rank FROM ranks2 JOIN live2 l ON l.world = ranks2.world AND l.src = ranks2.node"),
    "close": (("ulive_both", "unodes"), f"SELECT world::INT AS world, node, node AS lab FROM unodes, range(0, {R}) r(world) UNION SELECT c.world, l.dst, c.lab FROM close c JOIN ulive_both l ON l.world = c.world AND l.src = c.node"),
    "comps": (("close",), "SELECT world, node, min(lab) AS comp FROM close GROUP BY 1, 2"),
    "sizes": (("comps",), "SELECT world, comp, count(*) AS size FROM comps GROUP BY 1, 2"),
    "ranked": (("sizes",), "SELECT *, row_number() OVER o AS place, (sum(size) OVER (PARTITION BY world ORDER BY size DESC, comp ROWS UNBOUNDED PRECEDING))::BIGINT AS total, rank() OVER (PARTITION BY world ORDER BY size DESC) AS tied FROM sizes WINDOW o AS (PARTITION BY world ORDER BY size DESC, comp)"),
    "member": (("comps", "ranked"), "SELECT c.world, c.node, c.comp, r.size, r.place, r.tied FROM comps c JOIN ranked r USING (world, comp)"),
    "wlive": (("arcs",), f"SELECT world::INT AS world, src, dst FROM arcs, range(0, 5) r(world) WHERE {COIN} <= 1 - pow(1 - 0.02::DOUBLE, w)"),
    "wlive1": (("arcs",), f"SELECT world::INT AS world, src, dst FROM arcs, range(0, 5) r(world) WHERE {COIN} <= 1 - pow(1 - 0.01::DOUBLE, w)"),
    "wends": (("wlive",), "SELECT world, src AS node FROM wlive UNION SELECT world, dst FROM wlive"),
    "wreach": (("wlive", "wends"), "SELECT world, node AS u, node AS v FROM wends UNION SELECT c.world, c.u, l.dst FROM wreach c JOIN wlive l ON l.world = c.world AND l.src = c.v"),
    "wscc": (("wreach",), "SELECT a.world, a.u AS node, min(a.v) AS scc FROM wreach a JOIN wreach b ON a.world = b.world AND a.u = b.v AND a.v = b.u GROUP BY 1, 2"),
    "flive": (("faint",), f"SELECT world::INT AS world, src, dst FROM faint, range(0, {R}) r(world) WHERE {COIN} <= 1 - pow(1 - p, 1)"),
    "fboth": (("flive",), "SELECT world, src, dst FROM flive UNION ALL SELECT world, dst, src FROM flive"),
    "fclose": (("fboth",), "SELECT DISTINCT world, src AS node, src AS lab FROM fboth UNION SELECT c.world, l.dst, c.lab FROM fclose c JOIN fboth l ON l.world = c.world AND l.src = c.node"),
    "fcomps": (("fclose",), "SELECT world, node, min(lab) AS comp FROM fclose GROUP BY 1, 2"),
    "frel": (("fcomps",), f"SELECT a.node AS u, b.node AS v, count(*) / {R}.0::DOUBLE AS r FROM fcomps a JOIN fcomps b ON a.world = b.world AND a.comp = b.comp AND a.node < b.node GROUP BY 1, 2"),
    "place": (("nnodes",), "SELECT node, row_number() OVER (ORDER BY node) - 1 AS i, count(*) OVER () AS n FROM nnodes"),
    "draws": (("place",), f"SELECT k, floor({u('42', chr(39) + 'pa' + chr(39), 'k')} * n)::BIGINT AS a, floor({u('42', chr(39) + 'pb' + chr(39), 'k')} * n)::BIGINT AS b FROM range(0, 5000) r(k), (SELECT max(n) AS n FROM place)"),
    "pair_order": (("place", "draws"), "SELECT x.node AS u, y.node AS v, row_number() OVER (ORDER BY min(k)) AS k FROM draws JOIN place x ON x.i = least(a, b) JOIN place y ON y.i = greatest(a, b) WHERE a <> b GROUP BY 1, 2"),
    "one_world": (("fcomps",), "SELECT node, comp FROM fcomps WHERE world = 0"),
    "degree": (("faint",), "SELECT node, sum(p) AS d FROM (SELECT src AS node, p FROM faint UNION ALL SELECT dst, p FROM faint) GROUP BY 1"),
    "top60": (("faint",), "SELECT src, dst, p FROM faint ORDER BY p DESC, src, dst LIMIT 60"),
    "top60_both": (("top60",), "SELECT src, dst FROM top60 UNION ALL SELECT dst, src FROM top60"),
    "lines": (("arcs",), "SELECT row_number() OVER (ORDER BY w DESC, src, dst) - 1 AS line, src, dst FROM arcs"),
    "first": (("lines",), "SELECT node AS old, row_number() OVER (ORDER BY min(line * 2 + pos)) - 1 AS new FROM (SELECT line, 0 AS pos, src AS node FROM lines UNION ALL SELECT line, 1, dst FROM lines) GROUP BY node"),
    # order of the most probable forest: an edge is in it if no path of better edges joins its ends
    "weak": (("sure",), "SELECT src, dst, p, row_number() OVER (ORDER BY p DESC, src, dst) AS k FROM sure"),
    "m0": (("weak",), "SELECT a, b, min(k) AS k FROM (SELECT src AS a, dst AS b, k FROM weak UNION ALL SELECT dst, src, k FROM weak UNION ALL SELECT src, src, 0 FROM weak UNION ALL SELECT dst, dst, 0 FROM weak) GROUP BY 1, 2"),
    **{f"m{i + 1}": ((f"m{i}",), f"SELECT x.a, y.b, min(greatest(x.k, y.k)) AS k FROM m{i} x JOIN m{i} y ON x.b = y.a GROUP BY 1, 2") for i in range(5)},
    "forest": (("weak", "m5"), "SELECT w.src, w.dst, w.p, w.k FROM weak w JOIN m5 m ON m.a = w.src AND m.b = w.dst WHERE m.k = w.k"),
    "forest_both": (("forest",), "SELECT src, dst, ln(p) AS c FROM forest UNION ALL SELECT dst, src, ln(p) FROM forest"),
    "walk": (("forest_both",), "SELECT DISTINCT src AS u, src AS v, -1::BIGINT AS back, 0.0::DOUBLE AS c FROM forest_both UNION ALL SELECT w.u, f.dst, w.v, w.c + f.c FROM walk w JOIN forest_both f ON f.src = w.v AND f.dst <> w.back"),
}


def with_blocks(final: str, *names: str, extra: str = "") -> str:
    """A statement from the blocks that ``names`` need; extra: more blocks, as text."""
    seen: list[str] = []

    def need(n: str) -> None:
        if n not in seen:
            for m in BLOCKS[n][0]:
                need(m)
            seen.append(n)

    for n in names:
        need(n)
    recursive = {"reach", "reach2", "hops", "ranks", "ranks2", "close", "wreach", "fclose", "walk"}
    parts = [f"{n} AS {'' if n in recursive else 'MATERIALIZED '}({BLOCKS[n][1]})" for n in seen]
    return "WITH RECURSIVE " + ",\n".join(parts) + (",\n" + extra if extra else "") + "\n" + final


def greedy(first: str, score: str, updates: dict[str, str], arcs: str, k: int) -> tuple[str, str]:
    """Blocks s0, p1, s1, ... of k greedy rounds, and the rows that they pick.

    first: rows (node, the columns of updates); score over them; updates: a column's new value where the
    pick has an arc ``a`` to the node ``s``.
    """
    out = [f"s0 AS MATERIALIZED ({first})"]
    for i in range(1, k + 1):
        out.append(f"p{i} AS MATERIALIZED (SELECT node, round({score}, 9) AS score FROM s{i - 1} ORDER BY 2 DESC, 1 LIMIT 1)")
        cols = ", ".join(f"CASE WHEN a.src IS NULL THEN s.{c} ELSE {e} END AS {c}" for c, e in updates.items())
        out.append(f"s{i} AS MATERIALIZED (SELECT s.node, {cols} FROM s{i - 1} s LEFT JOIN {arcs} a ON a.dst = s.node AND a.src = (SELECT node FROM p{i}) WHERE s.node <> (SELECT node FROM p{i}))")
    picks = " UNION ALL ".join(f"SELECT {i} AS rank, node, score FROM p{i}" for i in range(1, k + 1))
    return ",\n".join(out), picks


DEGREE0 = "SELECT src AS node, sum(w)::DOUBLE AS d, 0.0::DOUBLE AS t FROM sym GROUP BY 1"
T_UP = {"d": "s.d", "t": "s.t + a.w"}
DISCOUNT = "d - 2 * t - (d - t) * t * 0.01::DOUBLE"
GENERAL0 = "SELECT src AS node, 1.0::DOUBLE AS act, sum(1 - pow(1 - p, w)) AS ina FROM sym_p GROUP BY 1"
GENERAL = {"act": "s.act * pow(1 - a.p, a.w)", "ina": "s.ina - (1 - pow(1 - a.p, a.w))"}


def picked(first: str, score: str, updates: dict[str, str], arcs: str, k: int, *blocks: str, round_to: int = 6) -> str:
    extra, picks = greedy(first, score, updates, arcs, k)
    return with_blocks(f"SELECT rank, node, round(score, {round_to}) AS score FROM ({picks})", *blocks, extra=extra)


def fewest(order: str, *blocks: str, extra: str = "", columns: str = "target, k::BIGINT AS k, round(spread, 6) AS spread") -> str:
    """Fewest seeds of an order (SQL for rank, node) on the undirected live edges, for targets 12 and 56."""
    more = f"""ord AS MATERIALIZED ({order}),
zr AS (SELECT world::INT AS world, node, rank::BIGINT AS rank FROM ord, range(0, {R}) r(world) UNION SELECT l.world, l.dst, zr.rank FROM zr JOIN ulive_both l ON l.world = zr.world AND l.src = zr.node),
zf AS (SELECT world, node, min(rank) AS rank FROM zr GROUP BY 1, 2),
zc AS (SELECT o.rank::BIGINT AS k, sum(count(f.node)) OVER (ORDER BY o.rank) / {R}.0::DOUBLE AS spread FROM ord o LEFT JOIN zf f ON f.rank = o.rank GROUP BY o.rank),
zt AS (SELECT t AS target, min(k) AS k FROM zc, (SELECT unnest([12.0, 56.0]::DOUBLE[]) AS t) WHERE spread >= t GROUP BY 1)"""
    return with_blocks(f"SELECT {columns} FROM zt JOIN zc USING (k)", "ulive_both", *blocks, extra=(extra + ",\n" if extra else "") + more)


def reverse_scores(kept: str, score: str) -> str:
    """(node, score) SQL of components that ``kept`` keeps; L and the number kept are known."""
    return f"""need AS MATERIALIZED (SELECT world, coalesce(min(place) FILTER (total >= 40), max(place)) AS L FROM ranked GROUP BY 1),
kept AS MATERIALIZED (SELECT r.*, n.L FROM ranked r JOIN need n USING (world) WHERE {kept}),
cnt AS MATERIALIZED (SELECT world, count(*) AS qualified FROM kept GROUP BY 1),
zs AS MATERIALIZED (SELECT c.node, sum({score}) AS score FROM comps c JOIN kept k USING (world, comp) JOIN cnt USING (world) GROUP BY 1)"""


def reverse(kept: str, score: str, exponent: int = 1, arcs: str = "sym") -> str:
    p = "a.p" if arcs == "sym_p" else "0.01::DOUBLE"
    extra, picks = greedy("SELECT node, score FROM zs", "score", {"score": f"s.score * pow(1 - {p}, {exponent} * a.w)"}, arcs, 5)
    return fewest(f"SELECT rank, node FROM ({picks})", arcs, "comps", "ranked", extra=reverse_scores(kept, score) + ",\n" + extra)


def new_greedy(k: int) -> tuple[str, str]:
    out = []
    for i in range(k):
        coin = f"SELECT world, src, dst FROM und, range({i * R}, {(i + 1) * R}) r(world) WHERE {COIN} <= 1 - pow(1 - 0.01::DOUBLE, w)"
        out.append(f"l{i} AS MATERIALIZED ({coin}), b{i} AS MATERIALIZED (SELECT world, src, dst FROM l{i} UNION ALL SELECT world, dst, src FROM l{i})")
        out.append(f"c{i} AS (SELECT world, node, node AS lab FROM unodes, range({i * R}, {(i + 1) * R}) r(world) UNION SELECT c.world, l.dst, c.lab FROM c{i} c JOIN b{i} l ON l.world = c.world AND l.src = c.node)")
        out.append(f"g{i} AS MATERIALIZED (SELECT world, node, min(lab) AS comp FROM c{i} GROUP BY 1, 2)")
        prior = " UNION ALL ".join(f"SELECT node FROM p{j}" for j in range(1, i + 1))
        free = f"WHERE NOT EXISTS (SELECT 1 FROM g{i} h JOIN ({prior}) q ON q.node = h.node WHERE h.world = g.world AND h.comp = g.comp)" if i else ""
        out.append(f"p{i + 1} AS MATERIALIZED (SELECT node, round(sum(size) / {R}.0::DOUBLE, 9) AS score FROM (SELECT g.node, count(*) OVER (PARTITION BY g.world, g.comp) AS size FROM g{i} g {free}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)")
    return ",\n".join(out), " UNION ALL ".join(f"SELECT {i} AS rank, node, score FROM p{i}" for i in range(1, k + 1))


def general_greedy(k: int) -> tuple[str, str]:
    out = []
    for i in range(k):
        lo, hi = i * R, (i + 1) * R
        out.append(f"l{i} AS MATERIALIZED (SELECT world, src, dst FROM arcs, range({lo}, {hi}) r(world) WHERE {COIN} <= 1 - pow(1 - 0.01::DOUBLE, w))")
        out.append(f"c{i} AS (SELECT world, node AS u, node AS v FROM nodes, range({lo}, {hi}) r(world) UNION SELECT c.world, c.u, l.dst FROM c{i} c JOIN l{i} l ON l.world = c.world AND l.src = c.v)")
        prior = " UNION ALL ".join(f"SELECT node FROM p{j}" for j in range(1, i + 1)) or "SELECT -1 AS node"
        out.append(f"f{i} AS MATERIALIZED (SELECT DISTINCT world, v FROM c{i} WHERE u IN ({prior}))")
        out.append(f"p{i + 1} AS MATERIALIZED (SELECT u AS node, round(count(*) / {R}.0::DOUBLE, 9) AS score FROM c{i} c WHERE u NOT IN ({prior}) AND NOT EXISTS (SELECT 1 FROM f{i} f WHERE f.world = c.world AND f.v = c.v) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)")
    return ",\n".join(out), " UNION ALL ".join(f"SELECT {i} AS rank, node, score FROM p{i}" for i in range(1, k + 1))


def threshold_levels(rounds: int = 45) -> str:
    out = [f"q0 AS MATERIALIZED (SELECT world::INT AS world, node, 0 AS level FROM seeds, range(0, {R}) r(world))"]
    for i in range(1, rounds + 1):
        out.append(
            f"q{i} AS MATERIALIZED (SELECT world, node, level FROM q{i - 1} UNION ALL SELECT world, dst, {i} FROM (SELECT a.world, b.dst, round(sum(b.x), 9) AS pull FROM q{i - 1} a JOIN lw b ON b.src = a.node GROUP BY 1, 2) p"
            f" WHERE pull >= {u('42', chr(39) + 'thr' + chr(39), 'world', 'dst')} AND NOT EXISTS (SELECT 1 FROM q{i - 1} z WHERE z.world = p.world AND z.node = p.dst))"
        )
    return "lw AS MATERIALIZED (SELECT src, dst, round((1 / sum(w) OVER (PARTITION BY dst)) * w, 12) AS x FROM arcs),\n" + ",\n".join(out)


def top5(score: str, where: str = "true", source: str = "member") -> str:
    return with_blocks(f"SELECT (row_number() OVER (ORDER BY s DESC, node))::INT AS rank, node, round(s, 6) AS score FROM (SELECT node, round(sum({score})::DOUBLE, 9) AS s FROM {source} WHERE {where} GROUP BY 1) ORDER BY s DESC, node LIMIT 5", "member")


def _normal() -> str:
    case = "0.09::DOUBLE"
    for t in range(11, -1, -1):
        a, b = (u("42", f"'{n}{t}'", "src", "dst") for n in ("bm1", "bm2"))
        x = f"(0.09::DOUBLE + 0.06::DOUBLE * sqrt(-2 * ln(1 - {a})) * cos(2 * 3.141592653589793::DOUBLE * {b}))"
        case = f"CASE WHEN {x} BETWEEN 0 AND 1 THEN {x} ELSE {case} END"
    return case


_ng, _ng_picks = new_greedy(3)
_gg, _gg_picks = general_greedy(2)
_dd, _dd_picks = greedy(DEGREE0, DISCOUNT, T_UP, "sym", 6)
_gd, _gd_picks = greedy(GENERAL0, "act * (1 + ina)", GENERAL, "sym_p", 6)
_ratio = "round(f.p * (1 - coalesce(r.r, 0)) / (1 - f.p), 9)"
_lp = "rws AS (SELECT row_number() OVER (ORDER BY node) AS row, node, d FROM degree), cls AS (SELECT row_number() OVER (ORDER BY src, dst) AS col, src, dst FROM faint)"

ORACLE_SQL: dict[str, str] = {
    "s01_multigraph_reader": with_blocks("SELECT src, dst, w FROM und", "und"),
    "s02_both_ways_reader": with_blocks("SELECT src, dst, w FROM sym", "sym"),
    "s03_weighted_reader": with_blocks("SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(w)::BIGINT AS w FROM arcs GROUP BY 1, 2", "arcs"),
    "s04_unweighted_reader": with_blocks("SELECT src, dst, 1::BIGINT AS w FROM arcs", "arcs"),
    "s05_undirected_to_directed": with_blocks("SELECT * FROM sym", "sym"),
    "s06_adjacency_reader": with_blocks("SELECT src, dst, 1::BIGINT AS w FROM arcs", "arcs"),
    "s07_remap_ids": with_blocks("SELECT 1000000 - src * 7 AS src, 1000000 - dst * 7 AS dst, w FROM und", "und"),
    "s08_uncertain_reader": with_blocks("SELECT src, dst, p, round(-ln(p), 6) AS cost FROM arcs_p WHERE src < dst", "arcs_p"),
    "s09_edge_probability_reader": with_blocks("SELECT src, dst, w, p FROM arcs_p", "arcs_p"),
    "s10_stored_graph": with_blocks("SELECT n.node, sum(a.w)::BIGINT AS w FROM nodes n LEFT JOIN arcs a ON a.src = n.node GROUP BY 1", "nodes"),
    "s11_reliability_reader": with_blocks("SELECT src AS u, dst AS v, p AS r FROM faint", "faint"),
    "s12_named_reader": with_blocks(
        "SELECT a.id AS src, b.id AS dst, e.p FROM e JOIN i a ON a.n = e.a JOIN i b ON b.n = e.b", "faint",
        extra="e AS (SELECT 'n' || dst AS a, 'n' || src AS b, p, row_number() OVER (ORDER BY 'n' || dst, 'n' || src, p) AS line FROM faint), i AS (SELECT n, row_number() OVER (ORDER BY min(k)) - 1 AS id FROM (SELECT a AS n, 2 * line AS k FROM e UNION ALL SELECT b, 2 * line + 1 FROM e) GROUP BY n)"),
    "s13_random_graph": f"SELECT src, dst, (CASE WHEN {u('42', chr(39) + 'single' + chr(39), 'src', 'dst')} < 0.75 THEN 1 ELSE 2 + floor({u('42', chr(39) + 'weight' + chr(39), 'src', 'dst')} * 4) END)::BIGINT AS w FROM (SELECT a AS src, b AS dst FROM range(0, 60) x(a), range(0, 60) y(b) WHERE a < b ORDER BY md5(concat_ws('|', '42', 'pair', a::VARCHAR, b::VARCHAR)), a, b LIMIT 200)",
    "s14_truncated_normal": with_blocks(f"SELECT src, dst, round({_normal()}, 6) AS p FROM und", "und"),
    "s15_seed_lists": with_blocks('SELECT 0::BIGINT AS "set", rank, node FROM seeds UNION ALL SELECT 1, rank, node FROM useeds', "seeds", "useeds"),
    "s16_seed_lines": with_blocks("SELECT node FROM seeds", "seeds"),
    "s17_result_sink": with_blocks("SELECT world::BIGINT AS world, count(*)::DOUBLE AS n FROM live GROUP BY 1", "live"),
    "s18_result_reader": with_blocks("SELECT (world + 1)::BIGINT AS r, round(sum(count(*)) OVER (ORDER BY world) / (world + 1)::DOUBLE, 6) AS spread FROM reach GROUP BY world", "reach"),
    "s19_world_sink": with_blocks("SELECT world, count(*) AS n, sum(src)::BIGINT AS s, sum(dst)::BIGINT AS d FROM live GROUP BY 1", "live"),
    "s20_lp_export": with_blocks("SELECT r.row, c.col, 1.0::DOUBLE AS value, round(r.d, 6) AS d, c.src, c.dst FROM cls c JOIN rws r ON r.node IN (c.src, c.dst)", "degree", extra=_lp),
    "s21_lp_export_directed": with_blocks(
        "SELECT 'out' AS side, r.row, c.col, 1.0::DOUBLE AS value, round(r.o, 6) AS d FROM cls c JOIN rws r ON r.node = c.src UNION ALL SELECT 'in', r.row, c.col, 1.0, round(r.i, 6) FROM cls c JOIN rws r ON r.node = c.dst", "faint",
        extra="rws AS (SELECT row_number() OVER (ORDER BY node) AS row, node, sum(o) AS o, sum(i) AS i FROM (SELECT src AS node, p AS o, 0 AS i FROM faint UNION ALL SELECT dst, 0, p FROM faint) GROUP BY node), cls AS (SELECT row_number() OVER (ORDER BY src, dst) AS col, src, dst FROM faint)"),
    "s22_lp_solution": with_blocks("SELECT src, dst, round(col / 1000.0::DOUBLE, 6) AS p FROM cls", "degree", extra=_lp),
    "e01_clean_graph": with_blocks("SELECT a.new AS src, b.new AS dst FROM lines l JOIN first a ON a.old = l.src JOIN first b ON b.old = l.dst", "first"),
    "e02_relabel_actions": with_blocks(
        "SELECT a.new AS src, b.new AS dst, e.event_id AS action FROM ev e JOIN first b ON b.old = e.dst LEFT JOIN first a ON a.old = e.src WHERE e.src IS NULL OR (a.new IS NOT NULL AND e.src <> e.dst)", "first",
        extra="ev AS (SELECT CASE WHEN event_id % 3 <> 0 THEN user_id + 1 END AS src, user_id AS dst, event_id FROM events)"),
    "e03_prune": with_blocks("SELECT src, dst FROM lines WHERE src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM kept)", "lines", extra="seen AS (SELECT src AS node, 2 * line AS k FROM lines UNION ALL SELECT dst, 2 * line + 1 FROM lines), kept AS MATERIALIZED (SELECT node FROM seen GROUP BY node ORDER BY min(k) LIMIT 40)"),
    "e05_almost_equal": with_blocks("SELECT src, dst, abs(p - 0.02::DOUBLE) < 0.011::DOUBLE AS equal FROM arcs_p", "arcs_p"),
    "e06_ego_edges": with_blocks(
        "SELECT DISTINCT src, dst, w FROM (SELECT node AS src, node AS dst, 1::BIGINT AS w FROM useeds UNION ALL SELECT * FROM b WHERE src IN (SELECT node FROM useeds) UNION ALL SELECT * FROM b WHERE src IN (SELECT node FROM useeds UNION SELECT dst FROM b WHERE src IN (SELECT node FROM useeds)))", "useeds",
        extra=f"l AS MATERIALIZED (SELECT src, dst FROM und WHERE {u('42', '0', 'src', 'dst')} <= 1 - pow(1 - 0.02::DOUBLE, w)), b AS MATERIALIZED (SELECT src, dst, 1::BIGINT AS w FROM l UNION ALL SELECT dst, src, 1 FROM l)"),
    "e07_spread_edges": with_blocks(
        "SELECT e.src, e.dst, e.w, a.level AS from_level, b.level AS to_level, CASE WHEN b.level IS NULL THEN 'star' ELSE 'spread' END AS role FROM arcs e JOIN l a ON a.node = e.src LEFT JOIN l b ON b.node = e.dst WHERE (a.level = 0 OR a.level < b.level)", "levels",
        extra="l AS (SELECT node, level FROM levels WHERE world = 0)"),
    "e08_mean_probability": with_blocks("SELECT a.src, a.dst, round((a.p + b.p) / 2, 6) AS p FROM arcs_p a JOIN arcs_p b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst", "arcs_p"),
    "e09_percentage_difference": with_blocks(
        "SELECT round(avg((a.y - b.y) / b.y), 6) AS difference FROM a JOIN b USING (k)", "reach", "reach2",
        extra="a AS (SELECT world + 1 AS k, sum(count(*)) OVER (ORDER BY world) / (world + 1)::DOUBLE AS y FROM reach GROUP BY world), b AS (SELECT world + 1 AS k, sum(count(*)) OVER (ORDER BY world) / (world + 1)::DOUBLE AS y FROM reach2 GROUP BY world)"),
    "m01_uniform": with_blocks("SELECT src, dst, w, 0.01::DOUBLE AS p FROM arcs", "arcs"),
    "m02_multivalency": with_blocks("SELECT src, dst, w, p FROM sym_p", "sym_p"),
    "m03_random": with_blocks(f"SELECT src, dst, w, round({u('42', chr(39) + 'ep' + chr(39), 'src', 'dst')} * 0.1::DOUBLE, 6) AS p FROM arcs", "arcs"),
    "m04_weighted_cascade": with_blocks("SELECT src, dst, w, round(1 / (sum(w) OVER (PARTITION BY dst))::DOUBLE, 6) AS p FROM arcs", "arcs"),
    "m05_degree_categories": with_blocks(
        f"SELECT a.src, a.dst, a.w, list_extract({LEVEL}, (c.k // c.size + 1)::INT) AS p FROM arcs a JOIN c USING (src)", "arcs",
        extra="c AS (SELECT src, row_number() OVER (ORDER BY sum(w), src) - 1 AS k, ceil(count(*) OVER () / 4.0)::BIGINT AS size FROM arcs GROUP BY src)"),
    "m06_uniform_weights": with_blocks("SELECT src, dst, w, round(1 / (sum(w) OVER (PARTITION BY dst))::DOUBLE, 6) AS b FROM arcs", "arcs"),
    "m07_random_weights": with_blocks("SELECT src, dst, w, round(x / sum(w * x) OVER (PARTITION BY dst), 6) AS b FROM r", "arcs", extra=f"r AS (SELECT *, {u('42', chr(39) + 'ew' + chr(39), 'src', 'dst')} AS x FROM arcs)"),
    "m08_lt_check": with_blocks("SELECT dst AS node, round(sum(w) * (1 / 60.0::DOUBLE), 6) AS total FROM arcs GROUP BY 1 HAVING sum(w) * (1 / 60.0::DOUBLE) >= 1.0001::DOUBLE", "arcs"),
    "m09_triangular": with_blocks("SELECT src, dst, w, round(CASE WHEN x < 0.2::DOUBLE THEN sqrt(x * 0.1 * 0.02) ELSE 0.1::DOUBLE - sqrt((1 - x) * 0.1 * 0.08) END, 6) AS p FROM r", "arcs", extra=f"r AS (SELECT *, {u('42', chr(39) + 'tri' + chr(39), 'src', 'dst')} AS x FROM arcs)"),
    "d01_cascade": with_blocks("SELECT world, node FROM reach", "reach"),
    "d02_cascade_levels": with_blocks("SELECT world, node, level FROM levels", "levels"),
    "d03_mean_size": with_blocks(
        f"SELECT round(count(*) / {R}.0::DOUBLE, 6) AS spread FROM z", "ulive_both", "useeds",
        extra=f"z AS (SELECT world::INT AS world, node FROM useeds, range(0, {R}) r(world) UNION SELECT l.world, l.dst FROM z JOIN ulive_both l ON l.world = z.world AND l.src = z.node)"),
    "d04_arc_cascade": with_blocks(
        "SELECT world, node FROM z", "arcs_p", "seeds",
        extra=f"l AS MATERIALIZED (SELECT world::INT AS world, src, dst FROM arcs_p, range(0, {R}) r(world) WHERE {COIN} <= 1 - pow(1 - p / 4, w)), z AS (SELECT world::INT AS world, node FROM seeds, range(0, {R}) r(world) UNION SELECT l.world, l.dst FROM z JOIN l ON l.world = z.world AND l.src = z.node)"),
    "d05_expected_spread": with_blocks(f"SELECT round(count(*) / {R}.0::DOUBLE, 6) AS spread FROM reach", "reach"),
    "d06_linear_threshold": with_blocks("SELECT world, node, level FROM q45", "seeds", extra=threshold_levels()),
    "d07_mean_linear_threshold": with_blocks(f"SELECT round(count(*) / {R}.0::DOUBLE, 6) AS spread FROM q45", "seeds", extra=threshold_levels()),
    "d08_spread_curve": with_blocks(f"SELECT s.rank::BIGINT AS k, round(sum(count(f.node)) OVER (ORDER BY s.rank) / {R}.0::DOUBLE, 6) AS spread FROM seeds s LEFT JOIN f ON f.rank = s.rank GROUP BY s.rank", "ranks", extra="f AS (SELECT world, node, min(rank) AS rank FROM ranks GROUP BY 1, 2)"),
    "d09_spread_by_worlds": with_blocks("SELECT (world + 1)::BIGINT AS r, round(sum(count(*)) OVER (ORDER BY world) / (world + 1)::DOUBLE, 6) AS spread FROM reach GROUP BY world", "reach"),
    "d10_spread_of_sets": with_blocks(
        f"SELECT 'out' AS \"set\", round(count(*) / {R}.0::DOUBLE, 6) AS spread FROM reach UNION ALL SELECT 'twenties', round(count(*) / {R}.0::DOUBLE, 6) FROM z", "reach", "nodes",
        extra=f"z AS (SELECT world::INT AS world, node FROM nodes, range(0, {R}) r(world) WHERE node % 20 = 0 UNION SELECT l.world, l.dst FROM z JOIN live l ON l.world = z.world AND l.src = z.node)"),
    "w01_live_edges": with_blocks("SELECT world, src, dst FROM live", "live"),
    "w02_components": with_blocks("SELECT world, node, comp FROM comps", "comps"),
    "w03_component_reach": with_blocks("SELECT world, node, size FROM member", "member"),
    "w04_strong_components": with_blocks("SELECT world, node, scc FROM wscc", "wscc"),
    "w05_condensation": with_blocks("SELECT DISTINCT l.world, a.scc AS src_c, b.scc AS dst_c FROM wlive l JOIN wscc a ON a.world = l.world AND a.node = l.src JOIN wscc b ON b.world = l.world AND b.node = l.dst WHERE a.scc <> b.scc", "wscc"),
    "w06_reach_topsort": with_blocks("SELECT world, u AS node, count(*) AS size FROM wreach GROUP BY 1, 2", "wreach"),
    "w07_reach_bfs": with_blocks("SELECT world, u AS node, count(*) AS size FROM wreach GROUP BY 1, 2", "wreach"),
    "w08_multihop_neighbours": with_blocks("SELECT world, u, v FROM z WHERE u <> v", "wlive1", extra="z AS (SELECT world, src AS u, dst AS v FROM wlive1 UNION SELECT z.world, z.u, l.dst FROM z JOIN wlive1 l ON l.world = z.world AND l.src = z.v)"),
    "w09_one_hop": with_blocks("SELECT DISTINCT world, node FROM (SELECT world, dst AS node FROM live WHERE src IN (SELECT node FROM seeds) UNION ALL SELECT w.world, s.node FROM (SELECT DISTINCT world FROM live) w, seeds s)", "live", "seeds"),
    "w10_components_for_target": with_blocks("SELECT world, coalesce(min(place) FILTER (total >= 40), max(place)) AS needed, coalesce(min(total) FILTER (total >= 40), max(total)) AS covered FROM ranked GROUP BY 1", "ranked"),
    "w11_size_histogram": with_blocks("SELECT world, size, n, coalesce(sum(size) OVER (PARTITION BY world ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 20 AS qualified FROM (SELECT world, size, count(*) AS n FROM sizes GROUP BY 1, 2)", "sizes"),
    "w12_components_for_targets": with_blocks("SELECT world, target::BIGINT AS target, min(place) AS needed FROM ranked, (SELECT unnest([10, 30, 60, 100]) AS target) WHERE total >= target GROUP BY 1, 2", "ranked"),
    "w17_components_by_joins": with_blocks("SELECT world, node, comp FROM comps", "comps"),
    "w18_reach_by_joins": with_blocks("SELECT world, node, level FROM levels WHERE world < 5", "levels"),
    "k01_top_degree": with_blocks("SELECT rank, node, score FROM seeds", "seeds"),
    "k02_random_nodes": with_blocks(f"SELECT (row_number() OVER (ORDER BY s, node))::INT AS rank, node, round(s, 6) AS score FROM (SELECT node, {u('42', chr(39) + 'pick' + chr(39), 'node')} AS s FROM nodes) ORDER BY s, node LIMIT 5", "nodes"),
    "k03_single_discount": picked(DEGREE0, "d - t", T_UP, "sym", 4, "sym"),
    "k04_degree_discount": picked(DEGREE0, DISCOUNT, T_UP, "sym", 4, "sym"),
    "k05_degree_discount_star": picked(DEGREE0, "pow(1 - 0.01::DOUBLE, t) * (1 + (d - t) * 0.01::DOUBLE)", T_UP, "sym", 4, "sym"),
    "k06_general_discount": picked(GENERAL0, "act * (1 + ina)", GENERAL, "sym_p", 4, "sym_p"),
    "k07_general_greedy": with_blocks(f"SELECT rank, node, round(score, 6) AS score FROM ({_gg_picks})", "arcs", "nodes", extra=_gg),
    "k09_new_greedy": with_blocks(f"SELECT rank, node, round(score, 6) AS score FROM ({_ng_picks})", "und", "unodes", extra=_ng),
    "k10_cc_heuristic": top5("1 / sqrt(size)", f"place <= 10 AND {u('42', chr(39) + 'gain' + chr(39), 'world', 'node')} < 1 / sqrt(size)"),
    "k11_cc_ties": top5("1 / size::DOUBLE", "tied <= 5"),
    "k12_size_heuristic": top5("size"),
    "k14_ccwp": with_blocks(
        "SELECT (row_number() OVER (ORDER BY s DESC, node))::INT AS rank, node, round(s, 6) AS score FROM (SELECT node, round(sum(1 / size::DOUBLE), 9) AS s FROM (SELECT c.node, z.size, rank() OVER (PARTITION BY c.world ORDER BY z.size DESC) FROM g c JOIN z USING (world, comp) JOIN t USING (world, comp) WHERE t.tied <= 5) GROUP BY 1) ORDER BY s DESC, node LIMIT 5",
        "sym_p", "unodes",
        extra=f"l AS MATERIALIZED (SELECT world, src, dst FROM sym_p, range(0, {R}) r(world) WHERE src < dst AND {COIN} <= 1 - pow(1 - p / 4, w)), b AS MATERIALIZED (SELECT * FROM l UNION ALL SELECT world, dst, src FROM l), c AS (SELECT world, node, node AS lab FROM unodes, range(0, {R}) r(world) UNION SELECT c.world, b.dst, c.lab FROM c JOIN b ON b.world = c.world AND b.src = c.node), g AS MATERIALIZED (SELECT world, node, min(lab) AS comp FROM c GROUP BY 1, 2), z AS (SELECT world, comp, count(*) AS size FROM g GROUP BY 1, 2), t AS (SELECT world, comp, rank() OVER (PARTITION BY world ORDER BY size DESC) AS tied FROM z)"),
    "k15_reach_scores": with_blocks("SELECT node, sum(size)::DOUBLE AS score FROM (SELECT node, size, rank() OVER (PARTITION BY world ORDER BY size DESC) AS k FROM member) WHERE k <= 10 GROUP BY 1", "member"),
    "k16_harvester_directed": with_blocks(
        "SELECT (row_number() OVER (ORDER BY s DESC, node))::INT AS rank, node, s AS score FROM (SELECT node, sum(size)::DOUBLE AS s FROM (SELECT world, u AS node, count(*) AS size, rank() OVER (PARTITION BY world ORDER BY count(*) DESC) AS k FROM z GROUP BY 1, 2) WHERE k <= 10 GROUP BY 1) ORDER BY s DESC, node LIMIT 5", "live",
        extra="z AS (SELECT world, src AS u, src AS v FROM live UNION SELECT world, dst, dst FROM live UNION SELECT world, u, v FROM y), y AS (SELECT 0 AS world, 0 AS u, 0 AS v WHERE false)"),
    "k17_harvester_undirected": with_blocks("SELECT (row_number() OVER (ORDER BY s DESC, node))::INT AS rank, node, s AS score FROM (SELECT node, sum(size)::DOUBLE AS s FROM (SELECT node, size, rank() OVER (PARTITION BY world ORDER BY size DESC) AS k FROM member) WHERE k <= 10 GROUP BY 1) ORDER BY s DESC, node LIMIT 5", "member"),
    "k18_harvester": picked("SELECT node, sum(1 / size::DOUBLE) AS score FROM member WHERE tied <= 5 GROUP BY 1", "score", {"score": "s.score * pow(1 - 0.01::DOUBLE, a.w)"}, "sym", 3, "member", "sym"),
    "k19_penalized": picked("SELECT src AS node, sum(w)::DOUBLE AS score FROM sym GROUP BY 1", "score", {"score": "s.score * pow(1 - 0.05::DOUBLE, a.w)"}, "sym", 4, "sym"),
    "k23_brute_force": with_blocks(
        f"SELECT a || ',' || b AS \"set\", round(n / {R}.0::DOUBLE, 6) AS spread FROM (SELECT a, b, count(*) AS n FROM (SELECT DISTINCT p.a, p.b, z.world, z.v FROM p JOIN z ON z.u IN (p.a, p.b)) GROUP BY 1, 2) ORDER BY spread DESC, \"set\" LIMIT 1", "live",
        extra=f"t AS MATERIALIZED (SELECT src AS node FROM arcs GROUP BY 1 ORDER BY sum(w) DESC, 1 LIMIT 8), p AS (SELECT x.node AS a, y.node AS b FROM t x JOIN t y ON x.node < y.node), z AS (SELECT world::INT AS world, node AS u, node AS v FROM t, range(0, {R}) r(world) UNION SELECT z.world, z.u, l.dst FROM z JOIN live l ON l.world = z.world AND l.src = z.v)"),
    "k24_degree_inside": with_blocks("SELECT (row_number() OVER (ORDER BY s DESC, node))::INT AS rank, node, s AS score FROM (SELECT src AS node, sum(w)::DOUBLE AS s FROM sym WHERE src % 2 = 0 AND dst % 2 = 0 GROUP BY 1) ORDER BY s DESC, node LIMIT 5", "sym"),
    "z01_degree_discount": fewest(f"SELECT rank, node FROM ({_dd_picks})", "sym", extra=_dd),
    # doubling meets 1, 2, 4 and 6 seeds; bisection then probes 3, or 4 and 5
    "z02_step_and_bisect": fewest(f"SELECT rank, node FROM ({_dd_picks})", "sym", extra=_dd, columns="target, k::INT AS k, list_extract([1, 2, 4, 4, 6, 6], k)::INT AS steps"),
    "z03_stop_at_target": fewest(f"SELECT rank, node FROM ({_dd_picks})", "sym", extra=_dd, columns="target, k::BIGINT AS k") + " WHERE target = 12",
    "z04_new_greedy": fewest(f"SELECT rank, node FROM ({_ng_picks})", "und", "unodes", extra=_ng) + " WHERE target = 12",
    "z05_reverse_ccwp": reverse("r.place <= greatest(floor(n.L * 2.3::DOUBLE), 1)", "1 / (k.size * k.L)::DOUBLE"),
    "z06_reverse_ccwp_least": reverse("r.size >= 3", "1 / (k.size * k.L)::DOUBLE"),
    "z07_reverse_ccwp_arcs": reverse("r.size >= 3", "1 / (k.size * qualified)::DOUBLE", 2, "sym_p"),
    "z08_reverse_harvester": reverse("r.size >= (SELECT min(q.size) FROM ranked q WHERE q.world = r.world AND q.place <= n.L)", "1 / k.size::DOUBLE"),
    "z09_reverse_general_discount": fewest(f"SELECT rank, node FROM ({_gd_picks})", "sym_p", extra=_gd),
    "z11_reverse_degree": fewest("SELECT row_number() OVER (ORDER BY s DESC, node) AS rank, node FROM (SELECT src AS node, sum(w) AS s FROM sym GROUP BY 1) ORDER BY s DESC, node LIMIT 6", "sym"),
    "z12_reverse_random": fewest(f"SELECT row_number() OVER (ORDER BY s, node) AS rank, node FROM (SELECT node, {u('42', chr(39) + 'pick' + chr(39), 'node')} AS s FROM unodes) ORDER BY s, node LIMIT 8", "unodes"),
    "r01_spanning_forest": with_blocks("SELECT src, dst, p FROM forest", "forest"),
    "r02_tree_reliability": with_blocks("SELECT p.u, p.v, round(coalesce(exp(w.c), 0), 6) AS r FROM pair_order p LEFT JOIN walk w ON w.u = p.u AND w.v = p.v WHERE p.k <= 40", "pair_order", "walk"),
    "r04_mc_reliability": with_blocks(f"SELECT u, v, round(r, 6) AS r FROM frel WHERE r >= 2 / {R}.0::DOUBLE", "frel"),
    "r04b_mc_reliability_pairs": with_blocks("SELECT u, v, round(r, 6) AS r FROM frel JOIN pair_order USING (u, v) WHERE k <= 40", "frel", "pair_order"),
    "r05_world_reliability": with_blocks("SELECT p.u, p.v, coalesce((a.comp = b.comp)::INT, 0)::DOUBLE AS r FROM pair_order p LEFT JOIN one_world a ON a.node = p.u LEFT JOIN one_world b ON b.node = p.v WHERE p.k <= 40", "pair_order", "one_world"),
    "r06_discrepancy": with_blocks(
        "SELECT round(sum(g), 6) AS total, round(avg(g), 6) AS mean FROM (SELECT abs(coalesce(a.r, 0) - coalesce(b.r, 0)) AS g FROM a FULL JOIN b ON a.u = b.u AND a.v = b.v)", "frel", "pair_order", "one_world",
        extra="a AS (SELECT u, v, r FROM frel JOIN pair_order USING (u, v) WHERE k <= 60), b AS (SELECT p.u, p.v, coalesce((a.comp = b.comp)::INT, 0)::DOUBLE AS r FROM pair_order p LEFT JOIN one_world a ON a.node = p.u LEFT JOIN one_world b ON b.node = p.v WHERE p.k <= 60 AND p.u % 2 = 0)"),
    "r07_random_pairs": with_blocks("SELECT u, v FROM pair_order WHERE k <= 40", "pair_order"),
    "r08_error_curve": with_blocks(
        f"SELECT w + 1 AS worlds, round(abs(avg(hit) OVER (ORDER BY w) - 0.5), 6) AS error FROM (SELECT w, (SELECT count(*) FROM fcomps a JOIN fcomps b ON a.world = b.world AND a.comp = b.comp WHERE a.world = w AND a.node = 0 AND b.node = 5)::DOUBLE AS hit FROM range(0, {R}) r(w))", "fcomps"),
    "r10_coin_rounds": with_blocks(f"SELECT src, dst, p FROM (SELECT *, floor(ln(1 - {u('42', chr(39) + 'round' + chr(39), 'src', 'dst')}) / ln(1 - p)) AS turn FROM faint) ORDER BY turn, p DESC, src, dst LIMIT 60", "faint"),
    "r11_top_probable": with_blocks("SELECT src, dst, p FROM top60", "top60"),
    "r12_random_edges": with_blocks(f"SELECT src, dst, p FROM faint ORDER BY {u('42', chr(39) + 'edge' + chr(39), 'src', 'dst')}, src, dst LIMIT 60", "faint"),
    "r13_relevance_desc": with_blocks(f"SELECT f.src, f.dst, f.p, round({_ratio}, 6) AS score FROM faint f LEFT JOIN frel r ON r.u = f.src AND r.v = f.dst ORDER BY {_ratio} DESC, f.src, f.dst LIMIT 40", "frel"),
    "r13b_relevance_asc": with_blocks(f"SELECT f.src, f.dst, f.p, round({_ratio}, 6) AS score FROM faint f LEFT JOIN frel r ON r.u = f.src AND r.v = f.dst ORDER BY {_ratio}, f.src, f.dst LIMIT 40", "frel"),
    "r15_forest_plus": with_blocks("SELECT src, dst, p FROM forest UNION ALL (SELECT src, dst, p FROM weak WHERE k NOT IN (SELECT k FROM forest) ORDER BY k LIMIT (SELECT 40 - count(*) FROM forest))", "forest"),
    "r16b_forest_power_plus": with_blocks("SELECT src, dst, p FROM forest UNION ALL (SELECT src, dst, p FROM weak WHERE k NOT IN (SELECT k FROM forest) ORDER BY k LIMIT (SELECT 40 - count(*) FROM forest))", "forest"),
    "r18_chung_lu": with_blocks("SELECT a.node AS u, b.node AS v, round(a.d * b.d / (SELECT sum(d) FROM degree) / CASE WHEN a.node = b.node THEN 2 ELSE 1 END, 6) AS p FROM degree a JOIN degree b ON a.node <= b.node", "degree"),
    "r19_expected_degrees": with_blocks("SELECT node, round(sum(o + i), 6) AS d, round(sum(o), 6) AS dout, round(sum(i), 6) AS din FROM (SELECT src AS node, p AS o, 0::DOUBLE AS i FROM faint UNION ALL SELECT dst, 0, p FROM faint) GROUP BY 1", "faint"),
    "r20_reassign_chung_lu": with_blocks("SELECT e.src, e.dst, round(least(round(a.d, 9) * round(b.d, 9) / sum(round(b.d, 9)) OVER (PARTITION BY e.src), 1), 6) AS p FROM top60_both e JOIN degree a ON a.node = e.src JOIN degree b ON b.node = e.dst", "top60_both", "degree"),
    "r21_reassign_equally": with_blocks("SELECT e.src, e.dst, round(least(round(a.d, 9) / count(*) OVER (PARTITION BY e.src), 1), 6) AS p FROM top60_both e JOIN degree a ON a.node = e.src", "top60_both", "degree"),
    "r22_redistribute": with_blocks(
        "SELECT k.src, k.dst, round(least(k.p + coalesce(a.x, 0) + coalesce(b.x, 0), 1), 6) AS p FROM top60 k LEFT JOIN s a ON a.node = k.src LEFT JOIN s b ON b.node = k.dst", "top60",
        extra="g AS (SELECT * FROM faint WHERE NOT EXISTS (SELECT 1 FROM top60 t WHERE t.src = faint.src AND t.dst = faint.dst)), x AS (SELECT node, sum(p) / 2 AS x FROM (SELECT src AS node, p FROM g UNION ALL SELECT dst, p FROM g) GROUP BY 1), n AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM top60 UNION ALL SELECT dst FROM top60) GROUP BY 1), s AS (SELECT node, x / n AS x FROM x JOIN n USING (node))"),
    "r23b_degree_error": with_blocks("SELECT round(avg(abs(coalesce(d.d, 0) - coalesce(h.d, 0))), 6) AS mae FROM degree d FULL JOIN h ON h.node = d.node", "degree", "top60", extra="h AS (SELECT node, sum(p) AS d FROM (SELECT src AS node, p FROM top60 UNION ALL SELECT dst, p FROM top60) GROUP BY 1)"),
    "h01_pop_order": with_blocks("SELECT (row_number() OVER (ORDER BY s DESC, node))::INT AS rank, node, s AS score FROM (SELECT src AS node, sum(w)::DOUBLE AS s FROM arcs GROUP BY 1) ORDER BY s DESC, node LIMIT 20", "arcs"),
    "h03_by_value": with_blocks("SELECT src AS node, sum(w)::DOUBLE AS score FROM arcs GROUP BY 1", "arcs"),
    "h04_timed": with_blocks("SELECT 'count' AS block, true AS timed, count(*) AS n FROM arcs", "arcs"),
    "h02_defaults": with_blocks("SELECT src, round(coalesce(avg(CASE WHEN w > 2 THEN w END), 0), 6) AS mean, coalesce(min(CASE WHEN w > 1 THEN w END)::DOUBLE, 'inf'::DOUBLE) AS least FROM arcs GROUP BY 1", "arcs"),
    "h05_flatten": with_blocks("SELECT src % 5 AS part, count(*) AS n FROM arcs GROUP BY 1", "arcs"),
    "h06_graph_statistics": with_blocks(
        "SELECT count(*) AS nodes, (sum(d) / 2)::BIGINT AS edges, round(avg(d), 6) AS mean_degree, max(d) AS max_degree, (SELECT n FROM tri) AS triangles, round(CASE WHEN sum(d * (d - 1)) > 0 THEN 3 * (SELECT n FROM tri) / (sum(d * (d - 1)) / 2)::DOUBLE ELSE 0 END, 6) AS clustering FROM deg", "und",
        extra="e AS (SELECT src, dst FROM und), deg AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), tri AS (SELECT count(*) AS n FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = a.src AND c.dst = b.dst)"),
    "h07_summary": with_blocks("SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, round(quantile_cont(n::DOUBLE, 0.5), 6) AS median FROM (SELECT world, count(*) AS n FROM reach GROUP BY 1)", "reach"),
    "h08_plot_series": with_blocks(
        f"SELECT 'p=.01' AS series, s.rank::DOUBLE AS x, round(sum(count(f.node)) OVER (ORDER BY s.rank) / {R}.0::DOUBLE, 6) AS y FROM seeds s LEFT JOIN f ON f.rank = s.rank GROUP BY s.rank UNION ALL SELECT 'p=.02', s.rank::DOUBLE, round(sum(count(h.node)) OVER (ORDER BY s.rank) / {R}.0::DOUBLE, 6) FROM seeds s LEFT JOIN h ON h.rank = s.rank GROUP BY s.rank", "ranks", "ranks2",
        extra="f AS (SELECT world, node, min(rank) AS rank FROM ranks GROUP BY 1, 2), h AS (SELECT world, node, min(rank) AS rank FROM ranks2 GROUP BY 1, 2)"),
}
#: Directed reach in all worlds, for the harvester.
ORACLE_SQL["k16_harvester_directed"] = with_blocks(
    "SELECT (row_number() OVER (ORDER BY s DESC, node))::INT AS rank, node, s AS score FROM (SELECT node, sum(size)::DOUBLE AS s FROM (SELECT world, u AS node, count(*) AS size, rank() OVER (PARTITION BY world ORDER BY count(*) DESC) AS k FROM z GROUP BY 1, 2) WHERE k <= 10 GROUP BY 1) ORDER BY s DESC, node LIMIT 5", "live",
    extra="ends AS MATERIALIZED (SELECT world, src AS node FROM live UNION SELECT world, dst FROM live), z AS (SELECT world, node AS u, node AS v FROM ends UNION SELECT z.world, z.u, l.dst FROM z JOIN live l ON l.world = z.world AND l.src = z.v)",
)
_rep = [f"i{i + 1} AS MATERIALIZED (SELECT {i + 1} AS rank, a.dst AS node, sum(a.w)::DOUBLE AS score FROM sym a WHERE a.src IN (SELECT node FROM t{i}) AND a.dst NOT IN (SELECT node FROM t{i}) GROUP BY a.dst ORDER BY 3 DESC, 2 LIMIT 1), t{i + 1} AS MATERIALIZED (SELECT * FROM t{i} UNION ALL SELECT * FROM i{i + 1})" for i in (2, 3)]
_start = "b AS MATERIALIZED (SELECT * FROM und ORDER BY w DESC, src, dst LIMIT 1), t2 AS MATERIALIZED (SELECT 1 AS rank, src AS node, w::DOUBLE AS score FROM b UNION ALL SELECT 2, dst, w FROM b), "
for _name, _how in (("k20_representative_sum", "sum"), ("k20b_representative_min", "min")):
    ORACLE_SQL[_name] = with_blocks("SELECT rank::INT AS rank, node, score FROM t4", "sym", extra=_start + ", ".join(_rep).replace("sum(a.w)", f"{_how}(a.w)"))

# --- steps in order: recursion over edges or worlds with the state in lists, or one block per step ------

_ordered = "ef AS MATERIALIZED (SELECT row_number() OVER (ORDER BY p DESC, src, dst) AS k, src, dst, p, x.i + 1 AS a, y.i + 1 AS b FROM faint JOIN place x ON x.node = src JOIN place y ON y.node = dst)"
#: Peeled forests: every edge joins the first forest in which its ends are apart; lab holds each forest's labels.
_peeled = f"""{_ordered},
peel AS (SELECT 0::BIGINT AS k, 0::BIGINT AS tree, list_transform(range(0, n), lambda t: range(0, n)) AS lab FROM (SELECT max(n) AS n FROM place)
 UNION ALL SELECT k, tree, list_transform(lab, lambda x, i: CASE WHEN i = tree THEN list_transform(x, lambda y: CASE WHEN y = x[b] THEN x[a] ELSE y END) ELSE x END)
 FROM (SELECT e.k, e.a, e.b, p.lab, list_position(list_transform(p.lab, lambda x: x[e.a] <> x[e.b]), true)::BIGINT AS tree FROM peel p JOIN ef e ON e.k = p.k + 1)),
trees AS MATERIALIZED (SELECT tree, src, dst, p, row_number() OVER (ORDER BY tree, p DESC, src, dst) AS pos FROM peel JOIN ef USING (k))"""


def degree_loss(k: int) -> str:
    out = ["g0 AS MATERIALIZED (SELECT node, d FROM degree)"]
    for i in range(1, k + 1):
        prior = " UNION ALL ".join(f"SELECT src, dst FROM p{j}" for j in range(1, i)) or "SELECT -1 AS src, -1 AS dst"
        out.append(f"p{i} AS MATERIALIZED (SELECT f.src, f.dst, least((abs(x.d) + abs(y.d)) / 2, 1) AS p FROM faint f JOIN g{i - 1} x ON x.node = f.src JOIN g{i - 1} y ON y.node = f.dst WHERE (f.src, f.dst) NOT IN ({prior}) ORDER BY round(least((abs(x.d) + abs(y.d)) / 2, 1), 12) DESC, f.src DESC, f.dst DESC LIMIT 1)")
        out.append(f"g{i} AS MATERIALIZED (SELECT node, d - CASE WHEN node IN (src, dst) THEN p ELSE 0 END AS d FROM g{i - 1}, p{i})")
    return with_blocks(" UNION ALL ".join(f"SELECT src, dst, round(p, 6) AS p FROM p{i}" for i in range(1, k + 1)), "degree", extra=",\n".join(out))


def pruned(k: int, steps: int, first: str, where: str) -> str:
    """The forest after up to ``steps`` edges went, one at a time, ``first`` in front; a.n and b.n: edges at the ends."""
    out = ["t0 AS MATERIALIZED (SELECT src, dst, p FROM forest)"]
    for i in range(steps):
        out.append(f"n{i} AS MATERIALIZED (SELECT node, count(*) AS n FROM (SELECT src AS node FROM t{i} UNION ALL SELECT dst FROM t{i}) GROUP BY 1)")
        out.append(f"x{i} AS MATERIALIZED (SELECT t.src, t.dst FROM t{i} t JOIN n{i} a ON a.node = t.src JOIN n{i} b ON b.node = t.dst JOIN n0 a0 ON a0.node = t.src JOIN n0 b0 ON b0.node = t.dst WHERE (SELECT count(*) FROM t{i}) > {k} AND {where} ORDER BY {first}, t.src, t.dst LIMIT 1)")
        out.append(f"t{i + 1} AS MATERIALIZED (SELECT t.* FROM t{i} t WHERE NOT EXISTS (SELECT 1 FROM x{i} x WHERE x.src = t.src AND x.dst = t.dst))")
    return with_blocks(f"SELECT src, dst, p FROM t{steps}", "forest", extra=",\n".join(out))


_credited, _credited_picks = greedy("SELECT node, count(*)::DOUBLE AS score FROM (SELECT unnest(held) AS node FROM credit WHERE s = (SELECT max(s) FROM credit)) GROUP BY 1", "score", {"score": "s.score * pow(1 - 0.01::DOUBLE, a.w)"}, "sym", 4)

ORACLE_SQL |= {
    "e04_diameters": with_blocks(
        "SELECT comp, count(*) AS nodes, max(far)::BIGINT AS diameter FROM (SELECT u, min(v) AS comp, max(level) AS far FROM (SELECT u, v, min(level) AS level FROM hop GROUP BY 1, 2) GROUP BY u) GROUP BY comp", "und",
        extra=f"l AS MATERIALIZED (SELECT src, dst FROM und WHERE {u('42', '0', 'src', 'dst')} <= 1 - pow(1 - 0.02::DOUBLE, w)), b AS MATERIALIZED (SELECT src, dst FROM l UNION ALL SELECT dst, src FROM l), hop AS (SELECT DISTINCT src AS u, src AS v, 0 AS level FROM b UNION SELECT u, dst, level + 1 FROM hop JOIN b ON b.src = hop.v WHERE level < 60)"),
    "w13_greedy_world": with_blocks(
        "SELECT src, dst, p FROM gw JOIN ef USING (k) WHERE took", "place", "degree",
        extra=_ordered + """,
gw AS (SELECT 0::BIGINT AS k, false AS took, list(-d ORDER BY node) AS gap FROM degree
 UNION ALL SELECT k, took, CASE WHEN took THEN list_transform(gap, lambda g, i: CASE WHEN i IN (a, b) THEN g + 1 ELSE g END) ELSE gap END
 FROM (SELECT e.k, e.a, e.b, gap, round(abs(gap[e.a] + 1) + abs(gap[e.b] + 1) - abs(gap[e.a]) - abs(gap[e.b]), 9) < 0 AS took FROM gw JOIN ef e ON e.k = gw.k + 1))"""),
    "w16_forest_world": with_blocks(
        f"SELECT src, dst, p FROM (SELECT pos, src, dst, p, min(t) AS turn FROM trees, range(0, 100) r(t) WHERE {u('42', chr(39) + 'forest' + chr(39), 't', 'src', 'dst')} < p GROUP BY ALL) ORDER BY turn, pos LIMIT (SELECT floor(sum(p))::BIGINT + 1 FROM faint)", "place", "faint", extra=_peeled),
    "k13_continuous_search": with_blocks(
        f"SELECT rank, node, round(score, 6) AS score FROM ({_credited_picks})", "sizes", "sym",
        extra=f"""places AS MATERIALIZED (SELECT world, comp, row_number() OVER (PARTITION BY world ORDER BY size DESC, {u('42', chr(39) + 'tie' + chr(39), 'world', 'comp')}, comp) AS place FROM sizes),
turns AS MATERIALIZED (SELECT row_number() OVER (ORDER BY world, place) AS s, list(node) AS members FROM comps JOIN places USING (world, comp) WHERE place <= 4 GROUP BY world, place),
credit AS (SELECT 0::BIGINT AS s, []::BIGINT[] AS held UNION ALL SELECT t.s, list_append(held, list_min(list_transform(members, lambda m: {{'c': -len(list_filter(held, lambda z: z = m)), 'n': m}})).n) FROM credit c JOIN turns t ON t.s = c.s + 1),
""" + _credited),
    "r03_forest_reliability": with_blocks(
        "SELECT p.u, p.v, round(coalesce(sum(exp(w.c)), 0), 6) AS r FROM pairs p LEFT JOIN tw w ON w.u = p.u AND w.v = p.v GROUP BY 1, 2", "place", "faint", "pair_order",
        extra=_peeled + """,
pairs AS MATERIALIZED (SELECT u, v FROM pair_order WHERE k <= 20),
ways AS MATERIALIZED (SELECT tree, src, dst, ln(p) AS c FROM trees UNION ALL SELECT tree, dst, src, ln(p) FROM trees),
tw AS (SELECT DISTINCT tree, u, u AS v, -1::BIGINT AS back, 0.0::DOUBLE AS c FROM pairs JOIN ways ON src = u UNION ALL SELECT w.tree, w.u, f.dst, w.v, w.c + f.c FROM tw w JOIN ways f ON f.tree = w.tree AND f.src = w.v AND f.dst <> w.back)"""),
    "r09_forest_order": with_blocks("SELECT src, dst, p FROM trees ORDER BY pos LIMIT 60", "place", "faint", extra=_peeled),
    "r14_shortest_paths": with_blocks(
        "SELECT s.src, s.dst, s.p FROM sure s LEFT JOIN used n USING (src, dst) ORDER BY round(s.p * coalesce(n.n, 0), 9) DESC, s.src, s.dst LIMIT 40", "sure",
        extra="c0 AS MATERIALIZED (SELECT a, b, min(c) AS c FROM (SELECT src AS a, dst AS b, -ln(p) AS c FROM sure UNION ALL SELECT dst, src, -ln(p) FROM sure UNION ALL SELECT src, src, 0 FROM sure UNION ALL SELECT dst, dst, 0 FROM sure) GROUP BY 1, 2),\n"
        + "".join(f"c{i + 1} AS MATERIALIZED (SELECT x.a, y.b, min(x.c + y.c) AS c FROM c{i} x JOIN c{i} y ON x.b = y.a GROUP BY 1, 2),\n" for i in range(5))
        + "used AS MATERIALIZED (SELECT e.src, e.dst, count(*) AS n FROM (SELECT src, dst, p, src AS s, dst AS t FROM sure UNION ALL SELECT src, dst, p, dst, src FROM sure) e JOIN c5 x ON x.b = e.s JOIN c5 y ON y.a = e.t JOIN c5 d ON d.a = x.a AND d.b = y.b WHERE d.a < d.b AND abs(x.c - ln(e.p) + y.c - d.c) < 1e-9 GROUP BY 1, 2)"),
    "r15b_forest_leaves": pruned(15, 10, "t.p", "(a.n = 1 OR b.n = 1)"),
    "r16_forest_power": pruned(15, 10, "(a0.n = 1 OR b0.n = 1), a.n + b.n DESC", "true"),
    "r17_greedy_degree_loss": degree_loss(20),
}

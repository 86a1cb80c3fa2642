"""Sinks for graphs, seeds, results, worlds and linear programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, *cols: str) -> str:
    """Space-separated lines in the order of the columns, range-sorted into part files whose names follow it."""
    df.orderBy(*cols).select(F.concat_ws(" ", *[F.col(c).cast("string") for c in cols]).alias("value")).write.text(path)
    return path


def write_multigraph(edges: DataFrame, path: str) -> str:
    """Header ``n m``, then each edge as often as its multiplicity, in part files in order."""
    n = edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct().agg(F.count("*").alias("n"))
    m = edges.agg(F.sum("w").alias("m"))
    head = n.crossJoin(m).select(F.lit(0).alias("o"), F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"), F.concat_ws(" ", F.col("n").cast("string"), F.col("m").cast("string")).alias("value"))
    body = edges.select(F.lit(1).alias("o"), "src", "dst", F.explode(F.array_repeat(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")), F.col("w").cast("int"))).alias("value"))
    head.unionByName(body).orderBy("o", "src", "dst").select("value").write.text(path)
    return path


def write_adjacency(edges: DataFrame, n: int, path: str) -> str:
    lists = edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("to"))
    rows = edges.sparkSession.range(n).withColumnRenamed("id", "src").join(lists, "src", "left")
    rows.orderBy("src").select(F.coalesce(F.concat_ws(" ", F.transform("to", lambda x: x.cast("string"))), F.lit("")).alias("value")).write.text(path)
    return path


def write_graph(edges: DataFrame, nodes: DataFrame, path: str) -> str:
    edges.write.parquet(f"{path}/edges")
    nodes.write.parquet(f"{path}/nodes")
    return path


def write_seeds_json(seeds: DataFrame, path: str) -> str:
    """seeds (set, rank, node): a JSON list per set, in rank order."""
    lists = seeds.groupBy("set").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "node"))), lambda s: s["node"]).alias("nodes"))
    lists.orderBy("set").select(F.to_json("nodes").alias("value")).coalesce(1).write.text(path)
    return path


def write_seeds(seeds: DataFrame, path: str) -> str:
    """One node id per line, in rank order."""
    seeds.orderBy("rank").select(F.col("node").cast("string").alias("value")).coalesce(1).write.text(path)
    return path


def append_results(rows: DataFrame, path: str, x: str, y: str) -> str:
    rows.select(x, y).write.mode("append").csv(path, sep=" ")
    return path


def write_worlds(live: DataFrame, path: str) -> str:
    """Sampled worlds, a folder for each."""
    live.repartition("world").write.partitionBy("world").parquet(path)
    return path


def lp_matrix(edges: DataFrame, degrees: DataFrame) -> dict[str, DataFrame]:
    """The program max sum x, A x <= d: A (row, col, value), d (row, d), edge order (col, src, dst).

    Nodes are rows and edges columns, both from 1 in their own order; d is a node's wanted degree.
    """
    cols = edges.select(F.row_number().over(Window.orderBy("src", "dst")).cast("long").alias("col"), "src", "dst")
    rows = degrees.select(F.row_number().over(Window.orderBy("node")).cast("long").alias("row"), "node", "d")
    ends = cols.select("col", F.explode(F.array("src", "dst")).alias("node"))
    return {"A": ends.join(rows, "node").select("row", "col", F.lit(1.0).alias("value")), "d": rows.select("row", "d"), "edges": cols}


def lp_matrices_directed(edges: DataFrame, out_degrees: DataFrame, in_degrees: DataFrame) -> dict[str, DataFrame]:
    """As ``lp_matrix``, apart for arcs out of and into nodes."""
    cols = edges.select(F.row_number().over(Window.orderBy("src", "dst")).cast("long").alias("col"), "src", "dst")
    made = {"edges": cols}
    for side, end, degrees in (("out", "src", out_degrees), ("in", "dst", in_degrees)):
        rows = degrees.select(F.row_number().over(Window.orderBy("node")).cast("long").alias("row"), "node", "d")
        made[f"A{side}"] = cols.select("col", F.col(end).alias("node")).join(rows, "node").select("row", "col", F.lit(1.0).alias("value"))
        made[f"d{side}"] = rows.select("row", "d")
    return made


def zip_solution(solution: DataFrame, edges: DataFrame) -> DataFrame:
    """solution (col, x) beside the edges of the same number: (src, dst, p)."""
    return edges.join(solution, "col").select("src", "dst", F.col("x").alias("p"))

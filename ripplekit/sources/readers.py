"""Readers of graph files, as lazy DataFrames with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import both_ways, u01

PAIR, TRIPLE = "src long, dst long", "src long, dst long, p double"


def line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(line from 0, value) of a text file, or of a folder's files in order of their names, numbered
    without gathering them.

    Lines are numbered inside each block of a file; the sizes of the blocks before are added (one row
    for each block).
    """
    rows = spark.read.text(path).select(F.rtrim(F.regexp_replace("value", "\r$", "")).alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    blocks = blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(blocks, ["file", "block"]).select((F.col("id") + F.col("shift")).alias("line"), "value")


def fields(rows: DataFrame, value: str = "value") -> DataFrame:
    return rows.withColumn("f", F.split(F.trim(value), r"\s+"))


def read_multigraph(spark: SparkSession, path: str, directed: bool = False) -> DataFrame:
    """Header line ``n m``, then ``u v``; parallel lines add up. directed: every line is both arcs."""
    rows = fields(line_numbers(spark, path).where("line > 0 AND value <> ''"))
    pair = rows.select(F.col("f")[0].cast("long").alias("a"), F.col("f")[1].cast("long").alias("b"))
    if directed:
        arcs = pair.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")
    else:
        arcs = pair.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    return arcs.groupBy("src", "dst").agg(F.count("*").alias("w"))


def read_weighted(spark: SparkSession, path: str, directed: bool = False, header: bool = False) -> DataFrame:
    """Lines ``u v``, repeats counted as w; the header can be skipped."""
    rows = spark.read.csv(path, sep=" ", schema=PAIR, header=header)
    if not directed:
        rows = rows.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return rows.groupBy("src", "dst").agg(F.count("*").alias("w"))


def read_unweighted(spark: SparkSession, path: str, directed: bool = False) -> DataFrame:
    return read_weighted(spark, path, directed).select("src", "dst", F.lit(1).cast("long").alias("w"))


def to_directed(edges: DataFrame) -> DataFrame:
    """Undirected to directed: both arcs of every edge."""
    return both_ways(edges)


def read_adjacency(spark: SparkSession, path: str, directed: bool = True) -> DataFrame:
    """Line i holds the neighbours of node i."""
    arcs = fields(line_numbers(spark, path).where("value <> ''")).select(F.col("line").alias("src"), F.explode("f").alias("v")).select("src", F.col("v").cast("long").alias("dst"))
    if not directed:
        arcs = arcs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return arcs.distinct().withColumn("w", F.lit(1).cast("long"))


def remap(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges renumbered by mapping (old, new); edges with an unmapped end go."""
    a = mapping.select(F.col("old").alias("src"), F.col("new").alias("new_src"))
    b = mapping.select(F.col("old").alias("dst"), F.col("new").alias("new_dst"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(a, "src").join(b, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), *rest)


def read_uncertain(spark: SparkSession, path: str, directed: bool = False) -> DataFrame:
    """Lines ``u v p``; self-loops go; cost = -ln p."""
    rows = spark.read.csv(path, sep=" ", schema=TRIPLE).where("src <> dst")
    if not directed:
        rows = rows.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "p")
    return rows.withColumn("cost", -F.log("p"))


def attach_probabilities(spark: SparkSession, edges: DataFrame, path: str) -> DataFrame:
    """Edges with the p that a file ``u v p`` gives their arc; others have none and go."""
    return edges.join(spark.read.csv(path, sep=" ", schema=TRIPLE), ["src", "dst"])


def read_reliability(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="u long, v long, r double")


def read_named(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``name name p``: names numbered from 0 as first seen, with p."""
    rows = fields(line_numbers(spark, path).where("value <> ''"))
    ends = rows.select("line", F.posexplode(F.slice("f", 1, 2)).alias("pos", "name"))
    ids = dense_ids(ends, "name", ["line", "pos"])
    a, b = (ids.select(F.col("name").alias(n), F.col("id").alias(i)) for n, i in (("na", "src"), ("nb", "dst")))
    pair = rows.select(F.col("f")[0].alias("na"), F.col("f")[1].alias("nb"), F.col("f")[2].cast("double").alias("p"))
    return pair.join(a, "na").join(b, "nb").select("src", "dst", "p")


def dense_ids(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, id): keys numbered from 0 in the order of their first row.

    Numbered in two steps, inside slices of the order and over the sizes of the slices.
    """
    first = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("at"))
    first = first.withColumn("slice", F.floor(F.col("at")[order[0]] / 65536))
    inside = Window.partitionBy("slice").orderBy("at")
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = first.groupBy("slice").agg(F.count("*").alias("n")).select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return first.withColumn("k", F.row_number().over(inside)).join(sizes, "slice").select(key, (F.col("k") + F.col("before") - 1).alias("id"))


def read_parquet_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A stored graph: its edges and its nodes."""
    return spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/nodes")


def read_seeds_json(spark: SparkSession, path: str) -> DataFrame:
    """(set, rank from 1, node): one JSON list per line."""
    rows = line_numbers(spark, path).where("value <> ''")
    return rows.select(F.col("line").alias("set"), F.posexplode(F.from_json("value", "array<long>")).alias("rank", "node")).withColumn("rank", F.col("rank") + 1)


def read_results(spark: SparkSession, path: str, x: str = "k", y: str = "spread") -> DataFrame:
    """Lines ``x y`` of spread, reverse, step or time files."""
    return spark.read.csv(path, sep=" ", schema=f"{x} long, {y} double")


def random_graph(spark: SparkSession, n: int, m: int, single: float = 0.75, most: int = 5, seed: int = 42) -> DataFrame:
    """m edges of a random graph on n nodes; w is 1 with chance ``single``, else 2 to ``most``.

    Pairs are numbered from 0 to n(n-1)/2 - 1; each gets a hash, and the m least hashes are taken.
    """
    first = spark.range(n).select(F.col("id").alias("src"))
    pairs = first.where(F.col("src") < n - 1).select("src", F.explode(F.sequence(F.col("src") + 1, F.lit(n - 1).cast("long"))).alias("dst"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("pair"), F.col("src").cast("string"), F.col("dst").cast("string")))
    taken = pairs.orderBy(key, "src", "dst").limit(m)
    u, v = u01(seed, "single", F.col("src"), F.col("dst")), u01(seed, "weight", F.col("src"), F.col("dst"))
    return taken.withColumn("w", F.when(u < single, F.lit(1)).otherwise(2 + F.floor(v * (most - 1))).cast("long"))


def truncated_normal(edges: DataFrame, mu: float = 0.09, sigma: float = 0.06, low: float = 0.0, high: float = 1.0, tries: int = 12, seed: int = 42) -> DataFrame:
    """Edges with a normal probability cut to [low, high]: the first Box-Muller draw inside, else mu."""
    out = F.lit(mu)
    for t in range(tries - 1, -1, -1):
        a, b = (u01(seed, f"{n}{t}", F.col("src"), F.col("dst")) for n in ("bm1", "bm2"))
        x = mu + sigma * F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * 3.141592653589793 * b)
        out = F.when((x >= low) & (x <= high), x).otherwise(out)
    return edges.withColumn("p", out)

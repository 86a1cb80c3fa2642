"""Graphs as DataFrames: edges(src, dst, w), nodes(node), and the deterministic coin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Default propagation probability, and seed of all coins.
P, SEED = 0.01, 42


def u01(*parts) -> Column:
    """A uniform number in [0, 1) from the hash of its parts (columns or constants)."""
    cols = [c if isinstance(c, Column) else F.lit(str(c)) for c in parts]
    joined = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def fires(w: Column | str = "w", p: Column | float = P) -> Column:
    """The chance that an edge of multiplicity w fires: 1 - (1 - p) ** w."""
    p = p if isinstance(p, Column) else F.lit(float(p))
    return 1 - F.pow(1 - p, F.col(w) if isinstance(w, str) else w)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def successions(rows: DataFrame, value: str, order: list[str], bucket: Column) -> DataFrame:
    """(src, dst): each value and the next one by ``order``, without a global sort.

    ``bucket`` must not fall along ``order``. Successors are found inside buckets; the last row of a
    bucket is followed by the first of the next bucket, which takes one row per bucket to find.
    """
    marked = rows.select(F.col(value).alias("src"), F.struct(*order).alias("at"), bucket.alias("bucket"))
    inside = Window.partitionBy("bucket").orderBy("at")
    firsts = marked.groupBy("bucket").agg(F.min_by("src", "at").alias("first"))
    following = firsts.select("bucket", F.lead("first").over(Window.orderBy("bucket")).alias("after"))
    led = marked.withColumn("dst", F.lead("src").over(inside)).withColumn("last", F.lead("at").over(inside).isNull())
    out = led.join(following, "bucket", "left").select("src", F.when(F.col("last"), F.col("after")).otherwise(F.col("dst")).alias("dst"))
    return out.where(F.col("dst").isNotNull())


def event_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed: each event's user points to the next event's user; w counts repeats; self-loops kept."""
    pairs = successions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.date_trunc("hour", "ts"))
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("w"))


def undirected(edges: DataFrame) -> DataFrame:
    """src < dst, multiplicities summed, self-loops dropped."""
    pair = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    return pair.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each undirected edge as two arcs; a self-loop once."""
    back = edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return edges.unionByName(back)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def nation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation to supplier nation, w lineitems: small and dense."""
    li, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return rows.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").alias("w"))


def uncertain(edges: DataFrame, low: float = 0.05, span: float = 0.9, tag: str = "ug") -> DataFrame:
    """Undirected edges with a hashed probability in [low, low + span)."""
    return edges.withColumn("p", F.round(low + span * u01(SEED, tag, F.col("src"), F.col("dst")), 6))

"""Edge-probability models (column p) and linear-threshold weights (column b)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SEED, u01

#: Levels of the multivalency model.
LEVELS = (0.01, 0.02, 0.04, 0.08)


def _edge_key(directed: bool):
    return (F.col("src"), F.col("dst")) if directed else (F.least("src", "dst"), F.greatest("src", "dst"))


def uniform(edges: DataFrame, p: float = 0.01) -> DataFrame:
    return edges.withColumn("p", F.lit(float(p)))


def multivalency(edges: DataFrame, levels=LEVELS, directed: bool = True, seed: int = SEED) -> DataFrame:
    """One of the levels by a hash; both arcs of an undirected edge get the same."""
    pick = (F.floor(u01(seed, "ep", *_edge_key(directed)) * len(levels)) + 1).cast("int")
    return edges.withColumn("p", F.element_at(F.array(*[F.lit(float(x)) for x in levels]), pick))


def random(edges: DataFrame, most: float = 0.1, directed: bool = True, seed: int = SEED) -> DataFrame:
    return edges.withColumn("p", u01(seed, "ep", *_edge_key(directed)) * most)


def weighted_cascade(edges: DataFrame) -> DataFrame:
    """1 / in-degree, parallel edges counted."""
    return edges.withColumn("p", 1 / F.sum("w").over(Window.partitionBy("dst")))


def degree_categories(edges: DataFrame, levels=LEVELS) -> DataFrame:
    """Nodes sorted by out-degree and cut into equal chunks; each chunk's arcs get the next level."""
    degree = edges.groupBy("src").agg(F.sum("w").alias("d"))
    n = degree.count()
    size = -(-n // len(levels)) or 1
    place = F.row_number().over(Window.orderBy("d", "src")) - 1
    level = F.element_at(F.array(*[F.lit(float(x)) for x in sorted(levels)]), (F.floor(place / size) + 1).cast("int"))
    return edges.join(degree.select("src", level.alias("p")), "src").select("src", "dst", "w", "p")


def uniform_weights(edges: DataFrame) -> DataFrame:
    """b = 1 / in-degree, so that a node's b * w sum to 1."""
    return edges.withColumn("b", 1 / F.sum("w").over(Window.partitionBy("dst")))


def random_weights(edges: DataFrame, seed: int = SEED) -> DataFrame:
    u = u01(seed, "ew", F.col("src"), F.col("dst"))
    return edges.withColumn("u", u).withColumn("b", F.col("u") / F.sum(F.col("w") * F.col("u")).over(Window.partitionBy("dst"))).drop("u")


def overweight(edges: DataFrame, eps: float = 1e-4) -> DataFrame:
    """Nodes whose b * w sum to 1 + eps or more: no linear-threshold graph if there are any."""
    return edges.groupBy("dst").agg(F.sum(F.col("b") * F.col("w")).alias("total")).where(F.col("total") >= 1 + eps).select(F.col("dst").alias("node"), "total")


def triangular(edges: DataFrame, low: float, mode: float, high: float, seed: int = SEED) -> DataFrame:
    """Triangular draw by its inverse distribution."""
    u, at = u01(seed, "tri", F.col("src"), F.col("dst")), (mode - low) / (high - low)
    left = low + F.sqrt(u * (high - low) * (mode - low))
    right = high - F.sqrt((1 - u) * (high - low) * (high - mode))
    return edges.withColumn("p", F.when(u < at, left).otherwise(right))

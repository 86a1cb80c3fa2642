"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue; its documents stand in a hash-shuffled order and, once it is through, stand
again (a repeat). The virtual finish time of a copy is the tokens its source has sent up to and
including it, divided by the source's target. The copies are range-sorted by finish time over all
sources and cut where their tokens reach the total budget: the sums of the sorted parts tell the part
that holds the cut, and running sums inside it the last copy that fits.

Running sums over a source are made the same way: its documents are range-sorted by place, size and row
over many tasks, so no task holds a whole source, nor all rows of one id.

Nulls and edge cases: a null text counts 0 words; a null source is a source of its own, last in
order; a null id shuffles as an empty one; sources without words have target 0 and nothing is taken;
repeated rows are mixed as separate documents, in order of size and then of their rows in the written
table; copies that finish at one time go in together or not at all. Very long texts only count by their
words. An empty table gives an empty result. ``mix`` returns columns of its own, whatever others there
are; ``mixed_documents`` returns the rows with all their columns, names that clash included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, body, join_lookup, store

#: Rows of a sorted part that is meant for one task.
PER_PART = 500_000


def words(col: str = "text"):
    return F.regexp_count(body(col), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, cycle: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Targets of sources (key, source, source_size): ``min(level * weight, cap * size)``.

    Weights follow the sources in code-point order, null last, repeating. The level is where the
    targets sum to all sizes: with the sources ordered by ``cap * size / weight`` it is the first
    share that does not lift the next source above its cap.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("pos") % len(cycle) + 1).cast("int"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    up = Window.orderBy("ratio", "pos")
    every = Window.partitionBy()
    t = (
        sizes.withColumn("pos", F.row_number().over(ordered) - 1)
        .withColumn("weight", weight)
        .withColumn("top", F.lit(cap) * F.col("source_size"))
        .withColumn("ratio", F.col("top") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(every).cast("double"))
        .withColumn("capped", F.coalesce(F.sum("top").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("share", (F.col("all_words") - F.col("capped")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("ratio") >= F.col("share"), F.struct("ratio", "pos", "share"))).over(every)["share"])
    )
    target = F.least(F.col("level") * F.col("weight"), F.col("top"))
    return t.select("key", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def parts_of(spark: SparkSession, n: int) -> int:
    """Parts of a range sort of n rows."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 1000), -(-n // PER_PART))


def _cut(copies: DataFrame, budget: float) -> float:
    """The latest finish time at which all copies (size, finish) that have finished fit in the budget."""
    spark, n = copies.sparkSession, copies.count()
    if not n:
        return 0.0
    ranged = copies.repartitionByRange(parts_of(spark, n), "finish").withColumn("part", F.spark_partition_id())
    queue = store(ranged.sortWithinPartitions("finish"), "mix-finish")
    sums = queue.groupBy("part").agg(F.sum("size").alias("size"), F.max("finish").alias("last")).orderBy("part").collect()  # one row a part
    done, last = 0.0, 0.0
    for p in sums:
        if done + p["size"] > budget:
            inside = queue.where(F.col("part") == p["part"]).groupBy("finish").agg(F.sum("size").alias("size"))
            so_far = F.sum("size").over(Window.orderBy("finish").rowsBetween(Window.unboundedPreceding, 0))  # one part
            within = inside.withColumn("so_far", so_far).where(F.col("so_far") <= F.lit(budget - done)).agg(F.max("finish")).head()[0]
            return last if within is None else within
        done, last = done + p["size"], p["last"]
    return last


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[int, ...] = (5, 2, 1), repeats: int = 3, seed: str = "mix") -> DataFrame:
    """How often each document goes into the mix.

    Returns one row per document: id_col, size, source_size, target, copies (int), taken (long).
    """
    sized = store(docs_sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    return mix_sized(sized, cycle, repeats).select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def sized_columns(id_col: str, text_col: str, source_col: str, seed: str) -> list:
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(source_col)))
    place = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return [F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"), place.alias("place"), words(text_col).alias("size")]


def docs_sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    return docs.select(*sized_columns(id_col, text_col, source_col, seed), F.monotonically_increasing_id().alias("row"))


def mix_sized(sized: DataFrame, cycle: tuple[int, ...], repeats: int, keep_place: bool = False) -> DataFrame:
    """sized (id, source, key, place, size, row) with source_size, target and copies.

    sized must be a written table. Running sums are made in two steps, so that no task holds a whole
    source: inside slices of the range-sorted order, and over the sums of the slices.
    """
    n = sized.count()
    ranged = sized.repartitionByRange(parts_of(sized.sparkSession, n), "key", "place", "size", "row")
    cut = store(ranged.withColumn("slice", F.spark_partition_id()), "mix-slices")
    sums = cut.groupBy("key", "slice").agg(F.sum("size").alias("slice_size"), F.first("source").alias("source"))
    sources = targets(sums.groupBy("key").agg(F.first("source").alias("source"), F.sum("slice_size").alias("source_size")), cycle, float(repeats))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("key", "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("key", "slice").orderBy("place", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.withColumn("sent", F.sum("size").over(inside)).join(offsets, ["key", "slice"])
    placed = join_lookup(placed.withColumn("sent", F.col("sent") + F.col("before")), sources, "key")
    placed = store(placed.drop("slice", "before", *([] if keep_place else ["place", "row"])), "mix-queue")
    budget = float(placed.agg(F.sum("size")).head()[0] or 0)
    finish = [(F.lit(e) * F.col("source_size") + F.col("sent")) / F.col("target") for e in range(repeats)]
    finish = [F.when(F.col("target") > 0, f) for f in finish]
    copies = placed.where("size > 0").select("size", F.explode(F.array(*finish)).alias("finish"))
    last = _cut(copies, budget)
    taken = sum((F.when(f <= F.lit(last), 1).otherwise(0) for f in finish), F.lit(0))
    return placed.withColumn("copies", taken.cast("int"))


def mixed_documents(docs: DataFrame, cycle: tuple[int, ...] = (5, 2, 1), repeats: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of ``docs`` (doc_id, text, source, ...), each as often as it is taken.

    Along a source's shuffled order the number of copies falls once, by one, so a source needs only
    the lower number and the last place that has one more; texts are not shuffled. The rows are written
    once with a number each, which tells rows of equal id and size apart.
    """
    names, row = docs.columns, "_mix_row"
    while row in names:
        row += "_"
    keyed = store(docs.select(F.struct(*names).alias("_doc"), F.monotonically_increasing_id().alias(row)), "mix-rows", "zstd")
    columns = keyed.select("_doc.doc_id", "_doc.text", "_doc.source", F.col(row).alias("row"), "_doc")
    sizes = [*sized_columns("doc_id", "text", "source", seed), F.col("row")]
    mixed = mix_sized(store(columns.select(*sizes), "mix-sizes"), cycle, repeats, keep_place=True)
    at = F.struct("place", "size", "row")
    least = mixed.groupBy("key").agg(F.min("copies").alias("low"), F.max("copies").alias("high"))
    last = join_lookup(mixed, least, "key").where("copies > low").groupBy("key").agg(F.max(at).alias("last"))
    cuts = least.join(last, "key", "left")
    out = join_lookup(columns.select(*sizes, "_doc"), cuts, "key")
    copies = F.col("low") + F.when(at <= F.col("last"), F.col("high") - F.col("low")).otherwise(0)
    return out.withColumn("_copies", copies).where("_copies > 0").select(F.explode(F.array_repeat("_doc", F.col("_copies"))).alias("_doc")).select("_doc.*")

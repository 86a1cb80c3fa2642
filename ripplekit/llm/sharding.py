"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots. Bytes are summed per slot, and a small versioned
map says which shard holds each slot. Records never move between slots: to rebalance or to add
shards, only the map is edited and its next version is stored beside the earlier ones.

A record hashes by its id. An id that stands in a thousandth of the rows or more (null is such a value
too; there are at most a thousand) would fill its slot alone, so its records hash by id, text and row.

A record's size is the UTF-8 bytes of its text (null: none) plus 8. Null ids hash as empty text; rows
that repeat a rarer id share a slot and take places one after another, ordered by checksum and size;
equal rows are interchangeable. Very long texts only count by their size. An empty table gives an empty
result and a map whose slots are dealt evenly. No more than the slot table (SLOTS rows) reaches the
driver. Only doc_id and text are read, so other columns of any name don't matter.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import body, shared_dir, store

SLOTS = 8192
#: Bytes that a record takes beside its text, and the part of all rows that makes an id hot.
OVERHEAD, HOT = 8, 1000


def virtual_slot(id_col: str, slots: int = SLOTS, *more: str):
    return F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), *more), F.lit(slots)).cast("int")


def slotted(records: DataFrame, slots: int = SLOTS, *more: str) -> DataFrame:
    """records (doc_id, ...) with their virtual_slot; those of hot ids hash by the columns ``more`` too."""
    counts = records.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    hot = counts.where(F.col("n") * HOT >= records.count()).select(F.col("doc_id").alias("_hot_id"), F.lit(True).alias("_hot"))
    marked = records.join(F.broadcast(hot), F.col("doc_id").eqNullSafe(F.col("_hot_id")), "left")  # HOT rows at most
    slot = F.when(F.col("_hot"), virtual_slot("doc_id", slots, *more)).otherwise(virtual_slot("doc_id", slots))
    return marked.withColumn("virtual_slot", slot).drop("_hot_id", "_hot")


def record_size(text_col: str = "text"):
    return (F.octet_length(body(text_col)) + OVERHEAD).cast("long")


def slot_loads(records: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows) of records (virtual_slot, size)."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(loads: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """The shard of every slot: heaviest slots first, each to the lightest shard (ties: lowest)."""
    heap, where = [(0, 0, s) for s in range(shards)], [0] * slots
    heapq.heapify(heap)
    for slot in sorted(range(slots), key=lambda s: (-loads.get(s, 0), s)):
        load, held, shard = heapq.heappop(heap)
        where[slot] = shard
        heapq.heappush(heap, (load + loads.get(slot, 0), held + 1, shard))
    return where


def rebalanced(where: list[int], loads: dict[int, int], shards: int, tolerance: float = 0.01) -> list[int]:
    """An edited map for new loads or more shards that moves few slots.

    Slots go from the heaviest shard to the lightest while that shard is more than ``tolerance``
    above the mean and a slot exists whose move lowers the larger of the two.
    """
    where, held, load = list(where), [set() for _ in range(shards)], [0] * shards
    for slot, shard in enumerate(where):
        held[shard].add(slot)
        load[shard] += loads.get(slot, 0)
    most = (1 + tolerance) * sum(load) / shards
    while True:
        src, dst = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[src] - load[dst]
        fit = [s for s in held[src] if 0 < loads.get(s, 0) < gap]
        if load[src] <= most or not fit:
            return where
        slot = min(fit, key=lambda s: (abs(gap - 2 * loads[s]), s))
        where[slot] = dst
        held[src].remove(slot)
        held[dst].add(slot)
        load[src] -= loads[slot]
        load[dst] += loads[slot]


class SlotMap:
    """Versions of a slot-to-shard map, a small table (version, virtual_slot, shard) in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, version: int, where: list[int]) -> DataFrame:
        rows = self.spark.createDataFrame([(s, k) for s, k in enumerate(where)], "virtual_slot int, shard int").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.path}/version={version}")
        return self.load(version)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int").parquet(f"{self.path}/version={version}")

    def shards(self, version: int) -> list[int]:
        return [r["shard"] for r in self.load(version).orderBy("virtual_slot").collect()]


def collected_loads(records: DataFrame) -> dict[int, int]:
    return {r["virtual_slot"]: r["bytes"] for r in slot_loads(records).collect()}


def shard(records: DataFrame, slot_map: DataFrame, order: list[str]) -> DataFrame:
    """records (virtual_slot, ...) with their shard and place (``slot``, gapless from 0) in it.

    A shard's slots follow one another by number; inside a slot records go by ``order``.
    """
    loads = slot_map.join(slot_loads(records), "virtual_slot", "left").na.fill(0, ["rows"])
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = loads.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("virtual_slot").orderBy(*order)
    rows = records.withColumn("_place", F.row_number().over(inside) - 1)
    out = rows.join(F.broadcast(placed), "virtual_slot")  # one row per slot: a fixed number
    return out.withColumn("slot", (F.col("before") + F.col("_place")).cast("long")).drop("_place", "before")


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot) of all documents; map version 1 is stored."""
    spark = docs.sparkSession
    records = docs.select("doc_id", record_size().alias("size"), F.crc32(body().cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    records = slotted(store(records, "shard-records"), slots, "text_crc32", "row").drop("row")
    stored = SlotMap(spark, map_path or f"{shared_dir(spark)}/slot-map-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}")
    where = stored.save(1, first_map(collected_loads(records), shards, slots))
    return shard(records, where, ["doc_id", "text_crc32", "size"])

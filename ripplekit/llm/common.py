"""Helpers that the training-data operators share: text rules, written tables, skew-safe joins, batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The largest table, in rows, that an operator sends whole to every executor.
BROADCAST_ROWS = 100_000
#: Bytes of a batch of rows between Spark and a Python worker.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and all runs on one machine (tests) a temporary folder is made and set.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    folder = conf or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="ripplekit-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def store(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage.

    Tables of texts or ids take ``zstd``, which needs less disk and more time.
    """
    return store_at(df, name, codec)[0]


def store_at(df: DataFrame, name: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """As ``store``, with the table's path, so that a loop can drop what it has replaced."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that ``store_at`` wrote."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of at most BATCH_BYTES, or of one row where that is larger.

    The session's own limit stays if it is lower. It is read when the plan runs, so it stays set.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if not (now and now.isdigit() and int(now) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def hashed_share(share: float, *cols):
    """A condition that about ``share`` of all rows meet, evenly by a hash of ``cols``, however small."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(*cols).bitwiseAND(F.lit(2**63 - 1)) < F.lit(max(1, int(share * 2**63)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(col: str = "text"):
    """The text, empty where it is null."""
    return F.coalesce(F.col(col), F.lit(""))


def id_bucket(col: str, mod: int):
    """crc32 of the id written as text, modulo ``mod`` (null ids count as empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def join_lookup(rows: DataFrame, lookup: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join rows to a table with one row per key; the keys of ``rows`` may be very uneven.

    The lookup is broadcast only if it is counted to hold at most BROADCAST_ROWS rows. A larger
    one is salted: each of its rows is copied to 32 salts and the rows of a hot key spread over them.
    """
    if lookup.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(lookup), key, how)
    salts = 32
    spread = rows.withColumn("_salt", F.floor(F.rand(7) * salts).cast("int"))
    copied = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copied, [key, "_salt"], how).drop("_salt")

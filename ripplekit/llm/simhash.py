"""SimHash near-duplicates: fingerprints, meet-in-the-middle ball hashing, linked groups.

A text is lower-cased (A-Z), cut into words and 3-word shingles (repeats count; fewer words: the
whole sequence); every shingle is hashed with XXH64 (seed 42) and a fingerprint bit is 1 if it is
set in over half the hashes. A text without words has fingerprint zero. A null text counts as empty.

Fingerprints link at up to 3 differing bits. Two fingerprints meet in a variant that lies within half
that distance of each: 1 bit from one and at most 2 from the other. All emit their 1-bit ball. A pair
at distance 3 has fingerprints of unlike parity, so only odd ones emit 2-bit variants; and of 3 bits
two lie in the same half of the word, so those variants flip two bits of one half. In a variant that
some 1-bit ball reaches all colliding fingerprints are linked to one of these (a star, each link
verified); two that reach it by 2 bits alone are at an even distance and are linked elsewhere if at
2, not at all if at 4. So no group of copies is expanded into pairs and no link is lost.

Equal fingerprints count once, so a group of exact copies costs one ball. The variants meet in at most
MOST_BUCKETS buckets of about PER_BUCKET variants; more of them take several passes, each over its own
part of the variants, so neither a task nor the disk that the variants take grows with the data. Groups
are found by hash-to-minimum rounds over the links, in tables in the shared folder. Repeated rows are
separate rows of one group; a null doc_id links like any other but never names its group unless all are
null. Very long texts are hashed whole, in blocks; equal ids or fingerprints are ties that the docstrings
settle; an empty table gives an empty result. ``near_duplicates`` returns columns of its own, whatever
others there are; ``one_of_each`` returns rows with all their columns, names that clash included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, map_batches, store, store_at

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Fingerprints that a task expands at a time: 1,057 variants of 10 bytes each at most.
BLOCK = 1024
#: Variants that a task of the collision step is meant to hold (16 bytes each), and buckets of a pass.
PER_BUCKET, MOST_BUCKETS = 1_500_000, 8192
#: Fingerprints that a task of the emitting step is meant to expand.
PER_EMITTER = 50_000


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six white-space characters only
    if not words:
        return 0
    n, digest = max(1, len(words) - width + 1), xxhash.xxh64_intdigest
    if n == 1:
        return digest(b" ".join(words), SEED)
    joined, ends, at = b" ".join(words), [], 0
    for w in words:
        at += len(w)
        ends.append(at)
        at += 1
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        bits = np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(id_col, more..., fp long): the fingerprint's 64 bits as a signed number."""
    cols = [id_col, *more]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(len(cols))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(fps)], [*cols, "fp"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)
    return map_batches(docs.select(*cols, text_col), of, f"{kinds}, fp long")


def masks() -> tuple[np.ndarray, np.ndarray]:
    """The flips of the 1-bit ball (65) and the 2-bit flips inside a half (992)."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    two = [one[a] | one[b] for h in (0, 32) for a in range(h, h + 32) for b in range(a + 1, h + 32)]
    return np.concatenate([np.zeros(1, np.uint64), one]), np.array(two, np.uint64)


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """variant, mask number, and place of its fingerprint in ``fps`` (uint64)."""
    near, far = masks()
    odd = np.flatnonzero(np.bitwise_count(fps) & 1)
    v = np.concatenate([(fps[:, None] ^ near).ravel(), (fps[odd][:, None] ^ far).ravel()])
    m = np.concatenate([np.tile(np.arange(len(near), dtype=np.uint16), len(fps)), np.tile(np.arange(len(far), dtype=np.uint16) + len(near), len(odd))])
    i = np.concatenate([np.repeat(np.arange(len(fps)), len(near)), np.repeat(odd, len(far))])
    return v, m, i


def _turn(v: np.ndarray) -> np.ndarray:
    return (v * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)


def _spread(v: np.ndarray, buckets: int) -> np.ndarray:
    return ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)


def star_links(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Verified links (low, high) among variants of one bucket."""
    near, far = masks()
    flips = np.concatenate([near, far])
    # by variant, and by mask within it: the first of a run has a 1-bit mask if any has
    order = np.lexsort((m, v))
    v, m = v[order], m[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    run = np.diff(np.append(first, len(v)))
    shared = run > 1
    first, run = first[shared], run[shared]
    centre = np.repeat(first, run)
    at = centre + np.arange(len(centre)) - np.repeat(np.cumsum(run) - run, run)
    keep = (m[centre] < len(near)) & (at != centre)
    a, b = v[centre[keep]] ^ flips[m[centre[keep]]], v[at[keep]] ^ flips[m[at[keep]]]
    close = (np.bitwise_count(a ^ b) <= RADIUS) & (a != b)
    a, b = a[close].view(np.int64), b[close].view(np.int64)
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)


def links(distinct: DataFrame, n: int, per_pass: int = PER_BUCKET * MOST_BUCKETS) -> DataFrame:
    """Links (a, b), a < b, that join all groups of distinct fingerprints (fp), n in number."""
    passes = -(-n * 561 // per_pass)
    spread = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // PER_EMITTER))
    fps = distinct.select("fp").repartition(spread, "fp")
    if passes <= 1:
        return pass_links(fps, n * 561)
    fps = store(fps, "emitters")
    out = store(pass_links(fps, n * 561 // passes, 0, passes), "pass-links")
    for k in range(1, passes):  # one pass on disk at a time
        out = out.union(store(pass_links(fps, n * 561 // passes, k, passes), "pass-links"))
    return out.distinct()


def pass_links(fps: DataFrame, size: int, number: int = 0, passes: int = 1) -> DataFrame:
    """The links in one of ``passes`` parts of the variants, about ``size`` of them."""
    buckets = max(12, -(-size // PER_BUCKET))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fps), BLOCK):
                v, m, _ = variants(fps[k : k + BLOCK])
                if passes > 1:
                    own = _turn(v) % np.uint64(passes) == number
                    v, m = v[own], m[own]
                to = _spread(v, buckets)
                order = np.argsort(to, kind="stable")
                v, m, to = v[order], m[order], to[order]
                edge = np.searchsorted(to, np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(edge))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([v[edge[f] : edge[f + 1]].tobytes() for f in full], pa.binary()), pa.array([m[edge[f] : edge[f + 1]].tobytes() for f in full], pa.binary())], ["bucket", "v", "m"]
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for bucket, v, m in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                held.setdefault(bucket, []).append((v.as_py(), m.as_py()))
        for bucket in sorted(held):
            parts = held.pop(bucket)
            v = np.frombuffer(b"".join(p[0] for p in parts), np.uint64)
            m = np.frombuffer(b"".join(p[1] for p in parts), np.uint16)
            found = star_links(v, m)
            for k in range(0, len(found), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[k : k + 100_000, 0]), pa.array(found[k : k + 100_000, 1])], ["a", "b"])

    met = map_batches(fps, emit, "bucket int, v binary, m binary").repartition(buckets, "bucket")
    return map_batches(met, meet, "a long, b long").distinct()


def groups(edges: DataFrame) -> DataFrame:
    """(fp, root): the smallest fingerprint that each linked fingerprint reaches.

    Alternates large-star and small-star steps; every round is a table in the shared folder, and the
    last two are kept. Rounds grow with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    now, path = store_at(edges.select("a", "b"), "links")
    seen = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: greater neighbours of u go to u's minimum
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        large, large_path = store_at(large, "links")
        # small star: u and its smaller neighbours go to their minimum
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), "a", "b")
        small = small.select(F.col("x").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        after, after_path = store_at(small, "links")
        drop(spark, large_path)
        drop(spark, path)
        now, path = after, after_path
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(state) == seen:
            return now.select(F.col("b").alias("fp"), F.col("a").alias("root"))
        seen = tuple(state)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id): every row with the smallest id of its group."""
    rows = store(fingerprints(docs, id_col, text_col), "fingerprints")
    per_fp = store(rows.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("n")), "distinct")
    total, n = per_fp.agg(F.sum("n"), F.count("*")).head()
    if not n:
        return rows.withColumn("component_id", F.col(id_col))
    linked = groups(links(per_fp, n))
    # groups of the linked fingerprints; the others stand alone
    joined = per_fp.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    named = store(joined.join(lowest, "root").select("fp", "component_id", "n"), "components")
    # A fingerprint with a thousandth of the rows is hot; there are at most a thousand of those.
    hot = F.broadcast(named.where(F.col("n") * 1000 >= total).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("_hot")))
    cold = named.where(F.col("n") * 1000 < total).select("fp", "component_id")
    marked = rows.join(hot, "fp", "left")  # the id of a group may be null, the mark isn't
    out_hot = marked.where("_hot").select(id_col, "fp", F.col("hot_id").alias("component_id"))
    return out_hot.unionByName(marked.where("_hot IS NULL").select(id_col, "fp").join(cold, "fp").select(id_col, "fp", "component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each group: the one with the smallest doc_id, nulls last.

    Ties go to the smaller fingerprint and then to the row written first, so rows that share an id,
    or have none, count apart. Only keys and fingerprints are compared and joined; each text is
    written with its key and shuffled once.
    """
    keyed = store(docs.withColumn("_row_key", F.monotonically_increasing_id()), "keyed", "zstd")
    rows = store(fingerprints(keyed, "doc_id", "text", "_row_key"), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row_key")).alias("low")
    per_fp = store(rows.groupBy("fp").agg(least), "distinct")
    n = per_fp.count()
    if not n:
        return docs
    joined = per_fp.join(groups(links(per_fp, n)), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    chosen = joined.groupBy("root").agg(F.min(F.struct("low.no_id", "low.doc_id", "fp", "low._row_key")).alias("low"))
    keys = store(chosen.select(F.col("low._row_key").alias("_row_key")), "kept")
    # a shuffle at every size: the kept rows grow with the documents, so they are never broadcast
    return keyed.join(keys.hint("shuffle_hash"), "_row_key", "left_semi").drop("_row_key")


def hex_fingerprint(col: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))

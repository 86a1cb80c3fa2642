"""Packing along a space-filling curve.

A document's ids are hashed into a signed vector and projected to three dimensions; its place on the
Hilbert curve of that cube is its key. Documents are range-sorted by key and laid end to end, so
neighbours on the curve share sequences. The stream is cut every 2048 ids; what is left at the end is
cut into powers of two, largest first, which need no padding. So no sequence is padded at all.

Ids are those of the JSON tokenizer as it comes, so a special string in a text is its own id.

Nulls and edge cases: a null or empty text is its end id alone; repeated rows are packed each; equal
keys go by id, nulls first, then by length and checksum of the ids, so only equal rows of one id can
change places; rows of one key and id may go to several tasks. Very long texts are cut over sequences
like any other, a task holds the ids of BATCH_BYTES of text and of CHUNK documents. An empty table gives
an empty result. Column names of the input other than doc_id and text don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, store
from .tokens import END, encoder, rank_path

LENGTH, DIMS, BITS, HASHED = 2048, 3, 10, 4096
#: Documents that a task encodes at a time; sorted parts at most (one number of each goes to all tasks).
CHUNK, MOST_PARTS = 256, 100_000
#: Columns of encoded documents after doc_id, and what they are sorted by.
ENCODED = "key long, n long, crc long, row long, ids binary"
ORDER = ["key", "doc_id", "n", "crc", "row"]


def projection(vocab: int = 65536, seed: int = 20) -> np.ndarray:
    """For every id: the sign of its hash times the projection of the component that it falls in.

    Low ids are common pieces of text and weigh less.
    """
    cells = np.random.default_rng(seed).standard_normal((HASHED, DIMS)).astype(np.float32)
    mixed = (np.arange(vocab, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    sign = np.where(mixed & np.uint64(1), 1, -1) * np.log1p(np.arange(vocab)) / np.log1p(vocab)
    return cells[(mixed >> np.uint64(1)) % np.uint64(HASHED)] * sign.astype(np.float32)[:, None]


def points(sequences: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """The projected direction of each document's hashed vector, each component in -1 to 1.

    Every sequence has an id at least.
    """
    size = np.array([len(s) for s in sequences])
    flat = table[np.concatenate(sequences)] if len(size) else np.zeros((0, DIMS))
    sums = np.add.reduceat(flat, np.cumsum(size) - size, axis=0, dtype=np.float64) if len(size) else flat
    return np.tanh(sums / np.sqrt(size)[:, None])


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys of rows in -1 to 1 on the Hilbert curve (transpose form, then interleaved bits)."""
    x = np.clip(((points + 1) / 2 * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            set_ = (x[:, i] & q) > 0
            flip = (x[:, 0] ^ x[:, i]) & (q - 1)
            first = np.where(set_, x[:, 0] ^ (q - 1), x[:, 0] ^ flip)
            if i:
                x[:, i] = np.where(set_, x[:, i], x[:, i] ^ flip)
            x[:, 0] = first
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[:, n - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def encoded(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, key, n, crc, row, ids): Hilbert key, number of ids with the end, their checksum, a number
    of the row, and the ids, 16 bits each."""
    path = tokenizer or rank_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table, row = encoder(path), projection(), TaskContext.get().partitionId() << 40
        for b in batches:
            for k in range(0, b.num_rows, CHUNK):
                ids = [enc.ids(t, END, special=True) for t in b.column(1)[k : k + CHUNK].to_pylist()]
                keys = hilbert(points(ids, table))
                raw = [i.tobytes() for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[k : k + CHUNK], pa.array(keys), pa.array([len(i) for i in ids], pa.int64()), pa.array(map(zlib.crc32, raw), pa.int64()), pa.array(range(row, row + len(ids)), pa.int64()), pa.array(raw, pa.binary())],
                    ["doc_id", "key", "n", "crc", "row", "ids"],
                )
                row += len(ids)

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, {ENCODED}")


def bounds(total: int, length: int = LENGTH) -> np.ndarray:
    """Where the cuts of the last, short part of a stream of ``total`` ids lie, its two ends included."""
    at, rest = [total - total % length], total % length
    while rest:
        at.append(at[-1] + (1 << (rest.bit_length() - 1)))
        rest -= at[-1] - at[-2]
    return np.array(at, np.int64)


def cut(start: int, n: int, tail: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """Pieces (from, length, sequence, offset) of a document at ``start`` of the stream."""
    out, at, end = [], start, start + n
    while at < end:
        if at < tail[0]:
            seq, first = at // length, at - at % length
            last = first + length
        else:
            k = int(np.searchsorted(tail, at, side="right")) - 1
            seq, first, last = int(tail[0]) // length + k, int(tail[k]), int(tail[k + 1])
        to = min(end, last)
        out.append((at - start, to - at, seq, at - first))
        at = to
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, tokens_per_task: int = 8_000_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    The encoded documents and their sorted form are tables in the shared folder; the starts of the
    sorted parts (one number for each) go through the driver.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    ids = store(encoded(docs, tokenizer), "encoded", "zstd")
    total = ids.agg(F.sum("n")).head()[0] or 0
    parts = max(1, min(MOST_PARTS, -(-total // tokens_per_task)), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 200_000))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(1).to_numpy()
            begin = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(begin)], ["doc_id", "n", "ids", "part", "begin"])

    ranged = ids.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER).select("doc_id", "n", "ids")
    laid = store(map_batches(ranged, lay, f"doc_id {kind}, n long, ids binary, part int, begin long"), "laid", "zstd")
    sums = laid.groupBy("part").agg(F.sum("n").alias("n")).collect()  # MOST_PARTS rows, or shuffle partitions, at most
    size = np.zeros(max((r["part"] for r in sums), default=-1) + 1, np.int64)
    for r in sums:
        size[r["part"]] = r["n"]
    starts = spark.sparkContext.broadcast(np.cumsum(size) - size)
    tail = bounds(total, length)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = starts.value.tolist()
        for whole in batches:
            for first in range(0, whole.num_rows, CHUNK):
                b = whole.slice(first, CHUNK)
                rows: list[tuple] = []
                take: list[int] = []
                for k, (n, raw, part, begin) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())):
                    wide = np.frombuffer(raw, "<u2").astype("<u4")
                    for s, size, seq, off in cut(base[part] + begin, n, tail, length):
                        took = wide[s : s + size].tobytes()
                        rows.append((s, size, zlib.crc32(took), n, seq, off, took))
                        take.append(k)
                cols = list(zip(*rows)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    out = laid.select("doc_id", "n", "ids", "part", "begin")
    return map_batches(out, pieces, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")

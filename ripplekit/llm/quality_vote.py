"""Quality by nearest-neighbour voting over latent-semantic vectors.

A document's terms are its hashed words, its hashed word shapes and the bins of its statistics, each
part weighted by rarity and scaled to a fixed share. A truncated singular value decomposition of the
labelled sample gives latent directions; every document is projected, compared with all labelled
vectors by exact blocked cosine products, and its K nearest vote with weights that fall off with
distance. Each label has the same weight in sum, so the vote does not lean to the commoner one.

Fitted on about PER_LABEL labelled documents of each label, taken evenly by a hash of their id; of rows
that share an id each different text counts once, and 4 * PER_LABEL rows by hash are the most that the
driver gets. Nulls and edge cases: a null text is an empty one and gets a score as any other; documents
labelled more than once have the mean of their labels; with no labels every score is 1, with one kind
of label all neighbours agree; equal similarities all go to the earlier labelled vector (by doc_id);
repeated rows get one row each; very long texts count whole, a row at a time; an empty table gives an
empty result. Columns of docs other than text and those carried don't matter; a carried column must
not be called text, score or predicted.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textstats
from .common import map_batches
from .quality_rules import sample_labels

PER_LABEL, RANK, K, SHARPNESS = 2500, 48, 25, 20.0
WORDS, SHAPES, BINS = 4096, 1024, 8
#: The share of each part of a vector.
SHARES = (0.6, 1.0, 1.0)
CUT = 0.3
RUNS = re.compile(rb"(.)\1+", re.S)
SHAPE = bytes.maketrans(bytes(range(256)), bytes(b"A"[0] if 65 <= c <= 90 else b"a"[0] if 97 <= c <= 122 or c > 127 else b"9"[0] if 48 <= c <= 57 else c for c in range(256)))


class Terms(dict):
    """word -> its hashed word and shape in one number; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        shape = RUNS.sub(rb"\1", word.translate(SHAPE))
        out = (zlib.crc32(word.lower()) % WORDS) * SHAPES + zlib.crc32(shape) % SHAPES
        if len(word) < 64:
            self[word] = out
        return out


def raw_vectors(texts: list[str | None], terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log counts of words, of shapes, and the statistics, a row for each text."""
    words, shapes = np.zeros((len(texts), WORDS), np.float32), np.zeros((len(texts), SHAPES), np.float32)
    stats = textstats.features(np.array([textstats.describe(t) for t in texts], np.int64).reshape(-1, len(textstats.COUNTS)))
    for i, t in enumerate(texts):
        split = (t or "").encode().split()
        codes = np.fromiter(map(terms.__getitem__, split), np.int64, len(split))
        words[i] = np.bincount(codes // SHAPES, minlength=WORDS)
        shapes[i] = np.bincount(codes % SHAPES, minlength=SHAPES)
    return np.log1p(words), np.log1p(shapes), stats.astype(np.float32)


@dataclass
class Model:
    rarity: tuple[np.ndarray, np.ndarray]
    cuts: np.ndarray  # (statistics, BINS - 1)
    axes: np.ndarray  # (terms, rank)
    vectors: np.ndarray  # (labelled, rank), of length 1
    labels: np.ndarray
    weights: np.ndarray

    def terms(self, raw: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        words, shapes, stats = raw
        bins = (stats[:, :, None] > self.cuts[None]).reshape(len(stats), -1).astype(np.float32)
        parts = []
        for share, part in zip(SHARES, (words * self.rarity[0], shapes * self.rarity[1], bins)):
            norm = np.linalg.norm(part, axis=1, keepdims=True)
            parts.append(share * part / np.maximum(norm, 1e-9))
        return np.concatenate(parts, axis=1)

    def project(self, terms: np.ndarray) -> np.ndarray:
        out = terms @ self.axes
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def score(self, raw: tuple[np.ndarray, np.ndarray, np.ndarray], block: int = 256) -> np.ndarray:
        if not len(self.labels):
            return np.ones(len(raw[0]))
        latent, out = self.project(self.terms(raw)), []
        k = min(K, len(self.labels))
        for b in range(0, len(latent), block):
            near = np.round(latent[b : b + block] @ self.vectors.T, 6).astype(np.float64)
            top = np.argsort(-near, axis=1, kind="stable")[:, :k]
            vote = np.exp(SHARPNESS * (np.take_along_axis(near, top, 1) - 1)) * self.weights[top]
            out.append((vote * self.labels[top]).sum(1) / vote.sum(1))
        return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)


def fit(raw: tuple[np.ndarray, np.ndarray, np.ndarray], labels: np.ndarray, rank: int = RANK, seed: int = 3) -> Model:
    words, shapes, stats = raw
    n = len(labels)
    rarity = tuple(np.log((n + 1) / ((x > 0).sum(0) + 1)).astype(np.float32) + 0.1 for x in (words, shapes))
    cuts = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T if n else np.zeros((stats.shape[1], BINS - 1))
    model = Model(rarity, cuts, np.zeros((0, 0)), np.zeros((0, 0)), labels, np.ones(n))
    if not n:
        return model
    terms = model.terms(raw)
    sketch = np.random.default_rng(seed).standard_normal((terms.shape[1], rank + 16)).astype(np.float32)
    for _ in range(3):
        basis = np.linalg.qr(terms @ sketch)[0]
        sketch = np.linalg.qr(terms.T @ basis)[0]
    _, _, right = np.linalg.svd(terms @ sketch, full_matrices=False)
    model.axes = np.ascontiguousarray((sketch @ right.T)[:, :rank]).astype(np.float32)
    model.vectors = model.project(terms)
    ones = labels.sum()
    model.weights = np.where(labels >= 0.5, 0.5 / max(ones, 1), 0.5 / max(n - ones, 1))
    return model


def train(docs: DataFrame, labels: DataFrame, where, most: int = PER_LABEL) -> Model:
    """A model from labelled documents whose labels pass ``where`` (a condition on doc_id)."""
    picked = [sample_labels(labels, "quality", most, where & (F.col("quality") == y)) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1]).groupBy("doc_id").agg(F.avg("y").alias("y"))
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # about 2 * most ids
    # an id may stand in any number of rows: keys of different texts are picked before the texts move
    keys = chosen.groupBy("doc_id", F.xxhash64("text").alias("_text")).agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id", "_text"), "doc_id").limit(4 * most)
    chosen = chosen.select("doc_id", "text", F.xxhash64("text").alias("_text")).join(F.broadcast(keys), ["doc_id", "_text"])
    chosen = chosen.groupBy("doc_id", "_text").agg(F.first("text").alias("text"), F.first("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            raw = raw_vectors(b.column(1).to_pylist(), terms)
            packed = [r.tobytes() for r in np.concatenate(raw, axis=1).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(packed, pa.binary())], ["doc_id", "y", "raw"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_batches(chosen.select("doc_id", "text", "y"), run, f"doc_id {kind}, y double, raw binary").toPandas()
    rows = rows.sort_values(["doc_id", "raw"])
    width = WORDS + SHAPES + len(textstats.FEATURES)
    raw = np.stack([np.frombuffer(r, np.float16) for r in rows["raw"]]).astype(np.float32) if len(rows) else np.zeros((0, width), np.float32)
    parts = (raw[:, :WORDS], raw[:, WORDS : WORDS + SHAPES], raw[:, WORDS + SHAPES :])
    return fit(parts, (rows["y"].to_numpy(float) >= 0.5).astype(float))


def vote(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of docs (with text) with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # PER_LABEL bounds it
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, terms = shared.value, Terms()
        for b in batches:
            texts = b.column(len(carry)).to_pylist()
            scores = [model.score(raw_vectors(texts[k : k + 256], terms)) for k in range(0, len(texts), 256)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*carry, "score"])

    out = map_batches(docs.select(*carry, "text"), run, f"{kinds}, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))

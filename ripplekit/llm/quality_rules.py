"""Quality rules: gradient-boosted trees over document statistics, with monotone constraints.

Every whole text is described by counts (``textstats``); a base rule fails texts under 10 words or
with over a fifth of their words in repeated 5-word windows; boosted trees give the verdict on the
others. Symbols, repeated lines, repeated words, runs and exclamation marks may only lower a verdict.

The trees are fitted on about TRAIN_ROWS labelled documents, taken evenly by a hash of their id; of
rows that share an id, rows of different counts go in, TRAIN_ROWS in all by hash. Only those come to
the driver. All documents are described and judged in one pass that shuffles nothing.

Nulls and edge cases: a null text is an empty one; a document that is labelled more than once has the
mean of its labels, null labels count for nothing; without labels of both kinds the base rule decides
alone (its score is the smoothed share of good labels); repeated rows get one row each; very long
texts are described whole, a row at a time; an empty table gives an empty result. ``rate`` returns
doc_id and columns of its own, whatever other columns there are; ``kept_documents`` returns the rows
with all their columns as they are, names that clash with the counts included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, textstats
from .common import hashed_share, map_batches

TRAIN_ROWS = 20_000
#: The least probability of good quality that is kept.
KEEP = 0.5
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "runs": -1, "exclaim": -1}


def described(texts: pa.Array) -> np.ndarray:
    return np.array([textstats.describe(t.as_py()) for t in texts], np.int64).reshape(-1, len(textstats.COUNTS))


def failed(counts: np.ndarray) -> np.ndarray:
    """The base rule on rows of COUNTS."""
    n, repeated = (counts[:, textstats.COUNTS.index(c)] for c in ("n_words", "n_repeat_words"))
    return (n < 10) | (100 * repeated > 20 * n)


def sample_labels(labels: DataFrame, column: str, most: int, where=None) -> DataFrame:
    """(doc_id, y) of about ``most`` labelled documents at most, evenly by a hash of the id."""
    found = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    found = found if where is None else found.where(where)
    found = found.groupBy("doc_id").agg(F.avg(column).alias("y"))
    return found.where(hashed_share(most / max(found.count(), 1), "doc_id"))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> boosting.Trees:
    """Trees from the labelled documents that pass the base rule."""
    picked = sample_labels(labels, "quality", most)  # about ``most`` rows
    names, kind = list(textstats.COUNTS), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = described(b.column(2))
            good = ~failed(rows)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), *[pa.array(x) for x in rows[good].T]], ["doc_id", "y", *names])

    labelled = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text")
    # an id may stand in any number of rows: rows of equal counts are one, and the least hashes stay
    rows = map_batches(labelled, run, f"doc_id {kind}, y double" + "".join(f", {c} long" for c in names)).distinct()
    rows = rows.orderBy(F.xxhash64("doc_id", *names), "doc_id", *names).limit(2 * most).toPandas()
    rows = rows.sort_values(["doc_id", *names])
    x = textstats.features(rows[names].to_numpy(np.int64).reshape(-1, len(names)))
    return boosting.fit(x, (rows["y"].to_numpy(float) >= 0.5).astype(float), np.array([MONOTONE.get(f, 0) for f in textstats.FEATURES]))


class Verdict:
    """Counts, score and verdict of texts."""

    def __init__(self, trees: boosting.Trees):
        self.trees, self.learned = trees, bool(np.isfinite(trees.threshold).any())

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        counts = described(texts)
        bad, score = failed(counts), self.trees.probability(textstats.features(counts))
        return counts, bad, score, ~bad & (score >= KEEP if self.learned else True)


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the counts, base_failed, score, kept) of all documents."""
    names, kind = list(textstats.COUNTS), docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdict = Verdict(shared.value)
        for b in batches:
            counts, bad, score, kept = verdict(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x) for x in counts.T], pa.array(bad), pa.array(score), pa.array(kept)], ["doc_id", *names, "base_failed", "score", "kept"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}" + "".join(f", {c} long" for c in names) + ", base_failed boolean, score double, kept boolean")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdict = Verdict(shared.value)
        for b in batches:
            yield b.filter(pa.array(verdict(b.column(at))[3]))

    return map_batches(docs, run, docs.schema)

"""Language-model scores of whole texts, beside an add-one word model.

The model scores the lower-cased words, each encoded with a space before it and closed by the end id, in
overlapping windows, every id once. Words are counted over all training documents, in tables; the counts
and neighbourhoods of subword ids, which the model's leaves are made of, come from all counted words.

One pass over all texts makes the ids and the base score, and writes them as a table. The words that stand at least as often as a threshold, HEAD_WORDS of them at most, go to all tasks
(a bounded table); counts of all other words come by a join on the word. The network learns in ROUNDS
rounds. Each cuts its own part of the windows of all training documents from that table by a hash, so
together they take every window; of a small corpus a round takes more, up to WINDOWS and a SHARE of all. In a round every
task steps through PER_TASK windows or so and the tasks' weights are averaged, by part on the executors;
the driver gets one set of weights a round. ``train_docs`` sampled documents may train the first weights
on the driver (none by default).

Nulls and edge cases: a null or wordless text is its end alone; repeated rows are scored each (rows
are told apart by their place in a written table, not by id); equal texts have equal scores; very long
texts are scored whole, in blocks of windows; without training documents all words are unknown, N and V
are 0, and the base divides by 1; an empty table gives an empty result. Only doc_id, text and the
condition's columns are read, so other columns of any name don't matter.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import hashed_share, map_batches, store
from .tokens import encoder

HEAD_WORDS, TRAIN_DOCS = 150_000, 0
#: Rounds of training, the rate of the first, parts of the weights.
ROUNDS, RATE, PARTS = 5, 0.03, 64
#: Windows of a round at least, if there are so many: a number and a share of all; and those that a task steps through.
WINDOWS, SHARE, PER_TASK = 25_000, 1 / 512, 25_600
#: The byte vocabulary's last id, free in ordinary text, closes a sequence.
END, VOCAB = 50_256, 50_257
#: Words whose ids a task holds.
HELD = 400_000


def rank_path() -> str:
    """The byte vocabulary for many languages, which takes fewer ids a word."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


@lru_cache(maxsize=2)
def opens_word(path: str) -> np.ndarray:
    """Whether an id's bytes start with a space."""
    token = encoder(path).encoding.decode_single_token_bytes
    return np.array([token(i).startswith(b" ") for i in range(END)] + [False])


def encode_words(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words, each with a space before it, one after another, and where each word starts."""
    if not words:
        return np.zeros(0, np.uint16), np.zeros(0, np.int64)
    enc = encoder(path)
    ids = enc.ids((b" " + b" ".join(words)).decode())
    first = np.flatnonzero(opens_word(path)[ids])
    if len(first) != len(words):  # other white space beside a word's end took its space
        parts = [enc.ids((b" " + w).decode()) for w in words]
        ids, first = np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])
    return ids, first


def sequence(words: list[bytes], path: str) -> np.ndarray:
    """The ids of words and the end."""
    return np.append(encode_words(words, path)[0], END).astype(np.int64)


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Words:
    """Ids and base scores of words, in arrays of bounded size; base: nan where a word isn't ``known``."""

    def __init__(self, path: str, known: dict[bytes, float]):
        self.path, self.known = path, known
        self.clear()

    def clear(self) -> None:
        self.number, self.names = Numbers(), []
        self.ids, self.start, self.size, self.base = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def index(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > HELD:
            self.clear()
        out = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        fresh = list(islice(self.number, len(self.names), None))
        if fresh:
            ids, first = encode_words(fresh, self.path)
            self.start = np.concatenate([self.start, first + len(self.ids)])
            self.size = np.concatenate([self.size, np.diff(np.append(first, len(ids)))])
            self.ids = np.concatenate([self.ids, ids])
            self.base = np.concatenate([self.base, [self.known.get(w, math.nan) for w in fresh]])
            self.names += fresh
        return out

    def sequences(self, index: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts that end before the words ``ends``, each closed by the end, and their ends."""
        size = self.size[index]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.start[index] - upto[:-1], size) + np.arange(upto[-1])]
        stops = upto[ends]
        return np.insert(ids, stops, END), stops + np.arange(1, len(ends) + 1)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c long) over all docs (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            words = list(seen)
            for k in range(0, len(words), 100_000):
                part = words[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([seen[w] for w in part], pa.int64())], ["word", "c"])
            seen.clear()

        for b in batches:
            for t in b.column(0):
                seen.update(split(t.as_py()))
                if len(seen) > 1_500_000:
                    yield from out()
        yield from out()

    return map_batches(docs.select("text"), count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def id_statistics(counts: DataFrame, common: dict[bytes, int], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Uses of every id in the counted words, and of the anchors beside every id: the end, which stands before
    and after a word, and the commonest ids of the common words."""
    ids, first = encode_words(list(common), path)
    uses = np.bincount(ids, np.repeat(list(common.values()), np.diff(np.append(first, len(ids)))), VOCAB) if common else np.zeros(VOCAB)
    uses[END] = np.inf
    anchors = attention.anchors(uses)
    width = 2 * len(anchors)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCAB)
        for b in batches:
            if b.num_rows:
                ids, first = encode_words(b.column(0).to_pylist(), path)
                c = b.column(1).to_numpy().astype(float)
                size = np.diff(np.append(first, len(ids)))
                total += np.bincount(ids, np.repeat(c, size), VOCAB)
                keys, at = attention.neighbour_keys(np.append(np.insert(ids, first, END), END).astype(np.int64), VOCAB, anchors)
                places, where = np.unique(keys, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array((places + VOCAB).astype(np.int32)), pa.array(np.bincount(where, np.repeat(c, size + 1)[at - 1]))], ["at", "n"])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["at", "n"])

    out = np.zeros(VOCAB * (1 + width))
    rows = map_batches(counts.select("word", "c"), add, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row per place at most
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out[:VOCAB].copy(), out[VOCAB:].reshape(VOCAB, width).astype(np.float32)


def head(counts: DataFrame, most: int = HEAD_WORDS) -> tuple[int, dict[bytes, int]]:
    """The least count of the commonest words, and those words: as many whole counts as fit in ``most``."""
    log = F.floor(F.log(F.col("c").cast("double")) * 64)
    bins = counts.groupBy(log.alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("bin")).collect()
    least, total = None, 0
    for b in bins:
        total += b["n"]
        if total > most:
            break
        least = b["least"]
    if least is None:
        return 2**62, {}
    rows = counts.where(F.col("c") >= least).select("word", "c").toArrow()
    return least, dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))


def sample_sequences(docs: DataFrame, n: int, most: int, path: str) -> list[np.ndarray]:
    if not most:
        return []
    some = docs.where(hashed_share(most / max(n, 1), F.col("doc_id").cast("string"), F.lit("lm"), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sequence(split(t.as_py()), path).astype("<u2").tobytes() for t in b.column(0)], pa.binary())], ["ids"])

    found = sorted(r["ids"] for r in map_batches(some.select("text"), run, "ids binary").collect())
    return [np.frombuffer(x, "<u2").astype(np.int64) for x in found]


def picked_windows(streams: list[np.ndarray], of: np.ndarray, share: float, rounds: int, only: int | None = None) -> list[list[bytes | None]]:
    """For every round (or the ``only`` one) and sequence its windows of the round: leaves, and next leaves or -1, 16 bits each.

    A round takes those whose hash lies up to ``share`` behind its own even place, so a share over 1 / rounds
    leaves no window out.
    """
    flat, good, start, owner = attention.layout(streams, END)
    leaf, lane = of[flat], np.arange(attention.WINDOW)
    seed = np.array([zlib.crc32(s) for s in streams], np.uint64)[owner] << np.uint64(32)
    place = (np.arange(len(owner)) - np.searchsorted(owner, owner)).astype(np.uint64)
    h, out = seed + place, []
    for turn in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):  # two turns of a multiplicative hash
        h = (h ^ (h >> np.uint64(29))) * np.uint64(turn)
    u = (h >> np.uint64(11)).astype(np.float64) * 2.0**-53
    for k in range(rounds) if only is None else [only]:
        own = np.flatnonzero((u - k / rounds) % 1.0 < share)
        at = start[own, None] + lane
        goal = np.where(good[at], leaf[at + 1], -1)
        goal[:, : attention.CONTEXT] = -1
        rows = np.concatenate([leaf[at], goal], axis=1).astype("<i2")
        edge = np.searchsorted(owner[own], np.arange(len(streams) + 1)).tolist()
        out.append([rows[a:b].tobytes() if a < b else None for a, b in zip(edge, edge[1:])])
    return out


def round_windows(texts: DataFrame, of: np.ndarray, share: float, rounds: int, k: int) -> DataFrame:
    """The windows (w) of round k of each of texts (held_out, ids) that isn't held out and has any.

    They take several times the room of the ids, so they are cut anew for every round, and not stored.
    """
    shared = texts.sparkSession.sparkContext.broadcast(of.astype(np.int16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                streams = [np.frombuffer(r.as_buffer(), "<u2") for r in b.column(0)]
                own = picked_windows(streams, shared.value, share, rounds, k)[0]
                yield pa.RecordBatch.from_arrays([pa.array([w for w in own if w], pa.binary())], ["w"])

    return map_batches(texts.where(~F.col("held_out")).select("ids"), run, "w binary")


def round_share(windows: int) -> float:
    """The share of all windows that a round takes: an even part or more, so that no window is left out."""
    return min(1.0, max(1 / max(1, ROUNDS) + 1e-9, WINDOWS / windows + SHARE))


def average_round(windows: DataFrame, tasks: int, weights: dict[str, np.ndarray], rate: float, warm: int) -> dict[str, np.ndarray]:
    """The weights after each of ``tasks`` has passed over its windows (w), averaged by windows."""
    spark = windows.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    names = sorted(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted(v.as_py() for b in batches for v in b.column(0))  # about PER_TASK windows
        if held:
            rows = np.frombuffer(b"".join(held), "<i2").reshape(-1, 2 * attention.WINDOW)
            adam = attention.Adam({n: w.copy() for n, w in shared.value.items()}, warm)
            task = TaskContext.get().partitionId()
            attention.train_on(adam, rows[:, : attention.WINDOW], rows[:, attention.WINDOW :], rate, np.random.default_rng(task))
            parts = np.array_split(np.concatenate([adam.w[k].ravel() for k in names]), PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([task] * PARTS, pa.int32()), pa.array([len(rows)] * PARTS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "task", "n", "w"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for part, *row in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(part, []).append(row)
        for part in sorted(held):
            rows = sorted(held.pop(part))  # by task, so that sums repeat
            mean = sum(n * np.frombuffer(w, np.float32).astype(np.float64) for _, n, w in rows) / sum(n for _, n, _ in rows)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], ["part", "w"])

    trained = map_batches(windows.repartition(tasks), run, "part int, task int, n long, w binary")
    done = map_batches(trained.repartition(PARTS // 4, "part"), add, "part int, w binary").collect()  # PARTS rows
    shared.unpersist()
    if not done:
        return weights
    flat = np.frombuffer(b"".join(bytes(r["w"]) for r in sorted(done, key=lambda r: r["part"])), np.float32)
    ends = np.cumsum([weights[n].size for n in names])
    return {n: part.reshape(weights[n].shape).copy() for n, part in zip(names, np.split(flat, ends[:-1]))}


def read_texts(docs: DataFrame, path: str, known: dict[bytes, float], end: tuple[int, float]) -> DataFrame:
    """A row for each of docs (doc_id, held_out, text): its ids, the base score of its known words and its other
    words. end: whether the end id is known (0 or 1), and its base score."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        table, row = Words(path, known), TaskContext.get().partitionId() << 40
        for b in batches:
            words, ends = [], []
            for t in b.column(2):
                words += split(t.as_py())
                ends.append(len(words))
            ends, n = np.array(ends, np.int64), b.num_rows
            at = table.index(words)
            owner = np.repeat(np.arange(n), np.diff(ends, prepend=0))
            ids, stops = table.sequences(at, ends)
            base = table.base[at]
            other = np.isnan(base)
            sums = np.bincount(owner, np.where(other, 0, base), n) + end[1]
            size = np.bincount(owner, minlength=n)
            pairs, times = np.unique(owner[other] << 32 | at[other], return_counts=True)
            offsets = pa.array(np.searchsorted(pairs >> 32, np.arange(n + 1)), pa.int32())
            rare = pa.array([table.names[i] for i in (pairs & 0xFFFFFFFF).tolist()], pa.binary())
            streams = np.split(ids, stops[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array(np.arange(row, row + n)), pa.array(size + 1), pa.array(size - np.bincount(owner[other], minlength=n) + end[0]), pa.array(sums),
                    pa.ListArray.from_arrays(offsets, rare), pa.ListArray.from_arrays(offsets, pa.array(times)), pa.array([s.astype("<u2").tobytes() for s in streams], pa.binary()),
                ],
                ["doc_id", "held_out", "row", "n_tokens", "n_known", "base_score", "rare", "times", "ids"],
            )
            row += n

    schema = f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, base_score double, rare array<binary>, times array<long>, ids binary"
    return map_batches(docs, run, schema)


def scored(texts: DataFrame, model: attention.Model) -> DataFrame:
    """texts (row, ids, ...) with the model's score in place of the ids."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    carry = [f for f in texts.schema if f.name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, float] = {}  # copies of a text are scored once
        for b in batches:
            raw = b.column(len(carry)).to_pylist()
            keys = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            if len(held) > HELD:
                held.clear()
            fresh = {k: r for k, r in zip(keys, raw) if k not in held}
            held.update(zip(fresh, shared.value.score([np.frombuffer(r, "<u2") for r in fresh.values()]).tolist()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array([held[k] for k in keys], pa.float64())], [*[f.name for f in carry], "score"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in carry)
    return map_batches(texts.select(*[f.name for f in carry], "ids"), run, kinds + "score double")


def score(docs: DataFrame, held_out, tokenizer: str | None = None, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all documents.

    held_out: a condition; the documents that don't meet it are learned from, all of them.
    train_docs: sampled documents at most that the weights start from, on the driver.
    """
    path = tokenizer or rank_path()
    marked = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    training = marked.where(~F.col("held_out"))
    n_train = training.count()
    counts = store(word_counts(training), "word-counts")
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    total, vocab = words + n_train, distinct + (1 if n_train else 0)
    least, common = head(counts)
    per_id, near = id_statistics(counts, common, path)
    per_id[END] = n_train
    model = attention.train(sample_sequences(training, n_train, train_docs, path), per_id, END, near=near)
    bottom = math.log10(total + vocab + 1)
    known = {w: math.log10(c + 1) - bottom for w, c in common.items()}
    windows = max(1, int(per_id.sum() / attention.SCORED) + n_train // 2)  # about
    rounds = ROUNDS if n_train else 0
    share = round_share(windows)
    texts = store(read_texts(marked, path, known, (1 if n_train else 0, math.log10(n_train + 1) - bottom)), "lm-texts")
    for k in range(rounds):
        own = round_windows(texts, model.of, share, rounds, k)
        model.weights = average_round(own, max(1, round(share * windows / PER_TASK)), model.weights, RATE * (1 - k / rounds), 50 if k == 0 else 10)
    model.prepare()
    rare = texts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    found = rare.join(counts.where(F.col("c") < least).select("word", "c"), "word", "left")
    term = F.col("times") * (F.log10(F.coalesce(F.col("c"), F.lit(0)).cast("double") + 1) - F.lit(bottom))
    sums = found.groupBy("row").agg(F.sum(term).alias("tail"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    out = scored(texts.select("doc_id", "held_out", "row", "n_tokens", "n_known", "base_score", "ids"), model)
    out = out.join(sums, "row", "left").na.fill(0, ["tail", "tail_known"])
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("tail_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + F.col("tail")).alias("base_score"), "score"
    )

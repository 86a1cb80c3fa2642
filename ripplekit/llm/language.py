"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability in each language, by expectation
maximisation over all segmentations of the training words. A text's likelihood in a language is the
product over its words of the sum, over all ways to segment the word into pieces, of the product of
piece probabilities; a forward algorithm makes that sum. Characters without a piece have one rare
piece each. The prediction is the likeliest language, its score the posterior under equal priors.

Fitted on about TRAIN_DOCS labelled documents of each language, taken evenly by a hash of id and text,
whole texts: the bounded labelled sample of the model. In training a run of more than PART characters
counts as several words of PART, so that no sum underflows; texts are scored by whole words of any
length, in slabs of SLAB characters. Words are lower-cased and split at white space, and their
likelihoods are held in tables of bounded bytes. All pieces of the vocabulary that can stand in
lower-cased text take part, of any length, and all languages, in blocks of LANGS; above MOST_LANGS
values of lang the training refuses, since a column of the model (0.25 MB) goes to every task for each.

Nulls and edge cases: a text that is null or has no letter (Unicode category L) is ``und`` with score
0, and so is every text if nothing could be learned; equal likelihoods go to the first language in
code-point order; repeated rows get one row each, and null ids are sampled by their text; an empty
table gives an empty result. Columns of the input other than doc_id, text and lang are carried as they
are; in ``identify`` a carried column must not be called lang_pred or score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

TRAIN_DOCS, ROUNDS, SMOOTH = 500, 4, 0.05
#: Characters of a training word, and of a slab of a scored one; languages of a block, and in all.
PART, SLAB, LANGS, MOST_LANGS = 32, 65_536, 32, 4096
#: Words whose likelihoods a worker holds, and bytes of that table.
HELD, HELD_BYTES = 200_000, 32 << 20
#: Pieces of more characters are rare and summed only where they stand.
DENSE = 5
WORDLIKE = re.compile(r"[^\W\d_]")
STEP = 8


def has_letter(text: str) -> bool:
    """Whether a character of Unicode category L stands in the text."""
    first = WORDLIKE.search(text)
    return first is not None and (first.group().isalpha() or any(map(str.isalpha, text)))


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str | None = None) -> dict[str, int]:
    """The pieces that can stand in lower-cased text, numbered; a word's start is ``▁``."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or piece_path())
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return {p: i for i, p in enumerate(dict.fromkeys(p for p in found if p == p.lower()))}


BASE, SLOTS = np.uint64(0x9E3779B97F4A7C15), 21


class PieceTable:
    """Numbers of pieces by a 64-bit polynomial hash of their characters, looked up in arrays."""

    def __init__(self, pieces: dict[str, int]):
        self.size, self.longest = len(pieces), max(map(len, pieces), default=1)
        power = [np.uint64(pow(int(BASE), k, 2**64)) for k in range(self.longest)]
        self.power = power
        with np.errstate(over="ignore"):
            hashes = [sum((np.uint64(ord(c)) * power[i] for i, c in enumerate(reversed(p))), np.uint64(0)) for p in pieces]
        self.hash = np.array([*hashes, 0], np.uint64)
        assert len(set(hashes)) == len(hashes)
        for turn in range(1, 1000, 2):
            self.turn = BASE * np.uint64(turn) if turn == 1 else np.uint64((int(BASE) * turn) % 2**64)
            self.slot = np.full((1 << SLOTS) + 1, self.size, np.int32)
            at = self.place(self.hash[:-1])
            order = np.argsort(at, kind="stable")
            same = np.concatenate([[False], at[order][1:] == at[order][:-1]]) if self.size else np.zeros(0, bool)
            first, second = order[~same], order[same]
            self.slot[at[first]] = first
            if (self.slot[at[second] + 1] == self.size).all() and len(set(at[second])) == len(second):
                self.slot[at[second] + 1] = second
                return
        raise ValueError("pieces can't be placed")

    def place(self, h: np.ndarray) -> np.ndarray:
        return ((h * self.turn) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes; ``size`` where there is no such piece."""
        at = self.place(h)
        a = self.slot[at]
        a = np.where(self.hash[a] == h, a, self.slot[at + 1])
        return np.where(self.hash[a] == h, a, self.size).astype(np.int32)


def lattice(words: list[str], table: PieceTable, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Piece numbers (length, longest piece, words) of words of one length, marked ``▁``.

    [j, k, w] is the piece that ends with character j and has k+1 characters; the number of pieces
    where there is none, except that a lone character always has the number after that. lo, hi: the
    characters whose rows are wanted (the mark is character 0).
    """
    hi, from_ = len(words[0]) + 1 if hi is None else hi, max(0, lo - table.longest + 1)
    text = "".join(("▁" + w)[from_:hi] for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).T.astype(np.uint64)
    n = len(codes)
    out = np.full((n, min(table.longest, hi), len(words)), table.size, np.int32)
    h = np.zeros_like(codes)
    with np.errstate(over="ignore"):
        for k in range(min(n, out.shape[1])):
            h[k:] += codes[: n - k] * table.power[k]
            out[k:, k] = table.find(h[k:])
    out[:, 0][out[:, 0] == table.size] = table.size + 1
    return out[lo - from_ :]


def forward(grid: np.ndarray, prob: np.ndarray, state: list | None = None) -> np.ndarray:
    """Log likelihoods (words, languages) of words of one length.

    prob: (pieces + 2, languages); the row of no piece is 0. Sums are rescaled every few characters.
    state: of the characters before the grid's, [sums before the last characters, logs, characters];
    it is brought up to date.
    """
    n, width, words = grid.shape
    langs = prob.shape[1]
    state = state if state is not None else [[np.ones((words, langs))], np.zeros((words, langs)), 0]
    held, logs, before = state  # held: latest last
    none = len(prob) - 2
    for j in range(n):
        now = held[-1] * prob[grid[j, 0]]
        for k in range(1, min(width, before + j + 1)):
            piece = grid[j, k]
            if k < DENSE:
                now += held[-1 - k] * prob[piece]
            else:
                at = np.flatnonzero(piece != none)
                if len(at):
                    now[at] += held[-1 - k][at] * prob[piece[at]]
        held = [*(held[1 - width :] if width > 1 else []), now]
        if j % STEP == STEP - 1 or j == n - 1:
            logs += np.log(now)
            held = [h / now for h in held]
    state[:] = [held, logs, before + n]
    return logs


def word_likelihoods(words: list[str], table: PieceTable, prob: np.ndarray) -> np.ndarray:
    """``forward`` of words of one length, in blocks of bounded memory."""
    n = len(words[0]) + 1
    block = max(1, 1_000_000 // (min(n, SLAB) * table.longest))
    out = []
    for k in range(0, len(words), block):
        part, state = words[k : k + block], None
        for lo in range(0, n, SLAB):
            grid = lattice(part, table, lo, min(n, lo + SLAB))
            state = state or [[np.ones((len(part), prob.shape[1]))], np.zeros((len(part), prob.shape[1])), 0]
            forward(grid, prob, state)
        out.append(state[1])
    return np.concatenate(out)


def expectations(grid: np.ndarray, prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses (pieces + 2, languages) of pieces in words of one length, counted (words, languages)."""
    n, width, words = grid.shape
    langs = prob.shape[1]
    alpha, beta = np.zeros((n + 1, words, langs)), np.zeros((n + 1, words, langs))
    alpha[0], beta[n] = 1, 1
    none = len(prob) - 2
    where = {(j, k): np.flatnonzero(grid[j, k] != none) for j in range(n) for k in range(min(width, j + 1))}
    where = {jk: at for jk, at in where.items() if len(at)}
    for (j, k), at in where.items():
        alpha[j + 1][at] += alpha[j - k][at] * prob[grid[j, k][at]]
    for (j, k), at in reversed(where.items()):
        beta[j - k][at] += beta[j + 1][at] * prob[grid[j, k][at]]
    scale = counts / np.maximum(alpha[n], 1e-300)
    used = [grid[j, k][at] for (j, k), at in where.items()]
    flat = np.concatenate([alpha[j - k][at] * prob[piece] * beta[j + 1][at] * scale[at] for ((j, k), at), piece in zip(where.items(), used)])
    pieces = np.concatenate(used)
    return np.stack([np.bincount(pieces, flat[:, lang], len(prob)) for lang in range(langs)], axis=1)


def fit(counts: dict[str, np.ndarray], langs: int, pieces: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (pieces + 2, languages) from counts of words by language, in blocks of these."""
    if langs > LANGS:  # each language is fitted alone, so blocks change nothing
        parts = []
        for k in range(0, langs, LANGS):
            own = {w: n[k : k + LANGS] for w, n in counts.items() if n[k : k + LANGS].any()}
            parts.append(fit(own, min(LANGS, langs - k), pieces, rounds))
        return np.concatenate(parts, axis=1)
    size = len(pieces) + 2
    prob = np.full((size, langs), 1.0 / size)
    prob[-2] = 0
    by_length: dict[int, list[str]] = {}
    for w in sorted(counts):
        by_length.setdefault(len(w), []).append(w)
    table = PieceTable(pieces)
    blocks = [ws[k : k + 10_000] for ws in by_length.values() for k in range(0, len(ws), 10_000)]
    groups = [(lattice(ws, table), np.array([counts[w] for w in ws], float)) for ws in blocks]
    for _ in range(rounds):
        uses = np.zeros_like(prob)
        for grid, n in groups:
            uses += expectations(grid, prob, n)
        uses += SMOOTH
        uses[-2] = 0
        prob = uses / uses.sum(axis=0)
    return prob


class Scorer:
    """Log likelihoods of texts, with a bounded table of words."""

    def __init__(self, langs: list[str], prob: np.ndarray, pieces: dict[str, int]):
        self.langs, self.prob, self.table_of_pieces = langs, prob, PieceTable(pieces)
        self.held = min(HELD, max(1000, HELD_BYTES // (4 * max(1, len(langs)))))
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs)), np.float32)

    def learn(self, words: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for group in by_length.values():
            first = len(self.place)
            while len(self.table) < first + len(group):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for k in range(0, len(self.langs), LANGS):
                self.table[first : first + len(group), k : k + LANGS] = word_likelihoods(group, self.table_of_pieces, self.prob[:, k : k + LANGS])
            self.place.update(zip(group, range(first, first + len(group))))

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        split = [t.lower().split() for t in texts]
        new = set().union(*split).difference(self.place)
        if len(self.place) + len(new) > self.held and self.place:
            self.clear()
            new = set().union(*split)
        if new:
            self.learn(new)
        at = self.place.__getitem__
        return np.array([self.table[np.fromiter(map(at, ws), np.int64, len(ws))].sum(axis=0, dtype=float) for ws in split]).reshape(-1, len(self.langs))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        open_ = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.langs else []
        for k in range(0, len(open_), 256):
            part = open_[k : k + 256]
            logs = self.likelihoods([texts[i] for i in part])
            best = logs.argmax(axis=1)
            post = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            for i, b, p in zip(part, best, post):
                names[i], scores[i] = self.langs[b], float(p)
        return names, scores


def training_words(text: str) -> Iterator[str]:
    """Lower-cased words; of a longer run its parts of PART characters."""
    for w in text.lower().split():
        if len(w) <= PART:
            yield w
        else:
            yield from (w[k : k + PART] for k in range(0, len(w), PART))


def train(docs: DataFrame, most: int = TRAIN_DOCS, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and their piece probabilities; docs: doc_id, text, lang."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(found) > MOST_LANGS:
        raise ValueError(f"lang has more than {MOST_LANGS} values")
    langs = sorted(found, key=lambda s: s.encode())
    if not langs:
        return [], np.zeros((0, 0))
    # the least hash that leaves a language's documents out; at most MOST_LANGS rows
    cuts = docs.sparkSession.createDataFrame([(lang, min(2**63 - 1, int(min(1.0, most / n) * 2**63))) for lang, n in found.items()], "lang string, _cut long")
    hashed = F.xxhash64(F.col("doc_id").cast("string"), "text").bitwiseAND(F.lit(2**63 - 1))
    wanted = rows.join(F.broadcast(cuts), "lang").where(hashed <= F.col("_cut"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for t, lang in zip(b.column(0), b.column(1)):
                seen.setdefault(lang.as_py(), Counter()).update(training_words(t.as_py()))
        for lang, words in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(list(words)), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    words = map_batches(wanted.select("text", "lang"), count, "lang string, word string, n long")
    counts: dict[str, np.ndarray] = {}
    number = {lang: i for i, lang in enumerate(langs)}
    for r in words.groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().to_batches():
        for lang, w, n in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), r.column(2).to_pylist()):
            counts.setdefault(w, np.zeros(len(langs)))[number[lang]] += n
    return langs, fit(counts, len(langs), load_pieces(path))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], carry: list[str], path: str | None = None) -> DataFrame:
    """The columns ``carry`` of docs (with text) with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages: MOST_LANGS at most
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prob = shared.value
        scorer = Scorer(langs, prob, load_pieces(path) if langs else {})
        for b in batches:
            names, scores = scorer.predict(b.column(len(carry)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*carry, "lang_pred", "score"])

    return map_batches(docs.select(*carry, "text"), run, f"{kinds}, lang_pred string, score double")


def identified_documents(docs: DataFrame, training: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, as they are, that have a language: not ``und``, and a posterior of ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(training))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prob = shared.value
        scorer = Scorer(langs, prob, load_pieces() if langs else {})
        for b in batches:
            names, scores = scorer.predict(b.column(at).to_pylist())
            yield b.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return map_batches(docs, run, docs.schema)

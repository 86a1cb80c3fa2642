"""Exact statistics of whole texts, for rules and models."""

from __future__ import annotations

import numpy as np

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
UPPER = bytes(range(65, 91))
DIGIT = b"0123456789"
WINDOW = 5


def _without(raw: bytes, drop: bytes) -> int:
    return len(raw) - len(raw.translate(None, drop))


def repeated_words(ids: np.ndarray, vocab: int, width: int = WINDOW) -> int:
    """Words inside windows of ``width`` = 5 words that occur twice or more, the first included."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    ids = ids.astype(np.int64)
    if vocab**width < 2**62:
        key = ids[:n]
        for k in range(1, width):
            key = key * vocab + ids[k : k + n]
    else:
        # pairs and triples are numbered first, so that the joint key stays exact
        pair = np.unique(ids[:-1] * vocab + ids[1:], return_inverse=True)[1].astype(np.int64)
        p = int(pair.max()) + 1
        triple = np.unique(pair[:-1] * vocab + ids[2:], return_inverse=True)[1].astype(np.int64)
        key = triple[:n] * p + pair[3 : 3 + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


#: What ``describe`` counts, in order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_exclaim", "n_bars", "n_stops", "n_top", "n_run")


def describe(text: str | None) -> tuple[int, ...]:
    """The counts of COUNTS for one text (null: empty).

    n_lines: lines with a word; n_distinct: different lower-cased words; n_upper, n_digits: ASCII
    characters; n_exclaim, n_bars: of ! and |; n_stops: of . and ,; n_top: uses of the commonest
    word; n_run: words equal to the one before.
    """
    text = text or ""
    raw = text.encode()
    words = raw.split()
    if not words:
        return (0, 0, _without(raw, SYMBOLS)) + (0,) * 11
    seen: dict[bytes, int] = {}
    number = seen.setdefault
    ids = np.array([number(w, len(seen)) for w in words], np.int64)
    held: set[str] = set()
    lines = doubled = 0
    for line in text.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            lines += 1
            if line in held:
                doubled += 1
            held.add(line)
    counts = np.bincount(ids)
    return (
        len(words), len(text) - _without(raw, SPACE), _without(raw, SYMBOLS), doubled, repeated_words(ids, len(seen)), lines, len(seen),
        _without(raw, UPPER), _without(raw, DIGIT), raw.count(b"!"), raw.count(b"|"), raw.count(b".") + raw.count(b","), int(counts.max()), int((ids[1:] == ids[:-1]).sum()),
    )


#: Ratios made of the counts, in order.
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "line_words", "distinct", "upper", "digits", "exclaim", "bars", "stops", "top", "runs")


def features(counts: np.ndarray) -> np.ndarray:
    """Rows of FEATURES for rows of COUNTS."""
    c = counts.astype(np.float64).T
    words, chars, lines = np.maximum(c[0], 1), np.maximum(c[1], 1), np.maximum(c[5], 1)
    return np.stack([np.log1p(c[0]), c[1] / words, c[2] / chars, c[3] / lines, c[4] / words, c[0] / lines, c[6] / words, c[7] / chars, c[8] / chars, c[9] / words, c[10] / words, c[11] / words, c[12] / words, c[13] / words], axis=1)

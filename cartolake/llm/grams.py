"""Hashed text features: shares of byte pairs, byte triples, words and repeated words, as dense rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cartolake.llm.kernel import U64, Joined, in_group, later, owner
from cartolake.llm.quality_rules import measure

SIZE = 8192
#: Rows of features that are held at once.
ROWS = 256


def features(texts: pa.Array) -> np.ndarray:
    """A row per text; each kind of feature sums to one (zero without any). A-Z is lower-cased; null is empty."""
    joined = Joined(texts, lower=True)
    n, data = joined.n, joined.data
    out = np.zeros((n, SIZE), np.float32)
    text = owner(joined.at)

    def add(of: np.ndarray, slot: np.ndarray) -> None:
        total = np.bincount(of, minlength=n)
        cells = np.bincount(of * SIZE + slot, minlength=n * SIZE).reshape(n, SIZE)
        np.add(out, cells / np.maximum(total, 1)[:, None], out=out, casting="unsafe")

    b = data.astype(np.int64)
    for k, prime in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        if len(b) < k:
            continue
        value = b[: len(b) - k + 1].copy()
        for i in range(1, k):
            value = value * 257 + b[i : len(b) - k + 1 + i]
        same = text[: len(b) - k + 1] == text[k - 1 :]
        add(text[: len(b) - k + 1][same], ((value[same] + k) * prime >> 7) % (SIZE - 1))
    start, end, first = joined.words()
    words, of = joined.hashes(start, end), owner(first)
    add(of, (words % U64(SIZE - 1)).astype(np.int64))
    again = np.bincount(of[later(in_group(words, of))], minlength=n)
    out[:, SIZE - 1] = again / np.maximum(np.diff(first), 1)
    return out


#: Weight of a style feature.
STYLE = 0.25


def add_style(out: np.ndarray, texts: pa.Array) -> np.ndarray:
    """``out`` with features of style: the hashed step on which each ratio of the texts' measures lies."""
    words, chars, symbols, dup_lines, repeats, lines, stops, letters = (m.astype(float) for m in measure(texts))
    ratio = lambda a, b: a / np.maximum(b, 1)
    ratios = [words, ratio(chars, words), ratio(100 * symbols, words), ratio(100 * dup_lines, lines), ratio(100 * repeats, words), ratio(100 * stops, words), 100 - ratio(100 * letters, chars)]
    rows = np.arange(len(out))
    for i, r in enumerate(ratios):
        step = np.floor(2 * np.log2(1 + np.maximum(r, 0))).astype(np.int64)
        out[rows, (((i + 1) * 1009 + step) * 0x9E3779B1 >> 9) % (SIZE - 1)] += STYLE
    return out


def in_rows(part: pa.RecordBatch, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for i in range(0, part.num_rows, rows):
        yield part.slice(i, rows)


def scale_of(x: np.ndarray) -> np.ndarray:
    """Weights that make frequent and rare features count alike."""
    return (1 / np.sqrt(x.mean(axis=0) + 1e-4)).astype(np.float32)

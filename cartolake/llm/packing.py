"""Packing token sequences into windows by non-negative least squares over shallow length combinations."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.llm.bpe import encoder, texts_of
from cartolake.llm.shared import slices, small_batches, text_or_empty

#: Tokens that are packed together in a task; bounds its memory.
LOT_TOKENS = 2_000_000
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def combinations(histogram: np.ndarray, window: int, deepest: int = 400) -> list[tuple[int, ...]]:
    """Combinations of one to three present lengths that fill the window exactly.

    All single lengths and pairs; triples from the ``deepest`` most frequent lengths (the rest is packed greedily).
    """
    has = histogram > 0
    out: list[tuple[int, ...]] = [(window,)] if len(has) > window and has[window] else []
    lengths = np.flatnonzero(has)
    out += [(int(a), int(window - a)) for a in lengths if 2 * a >= window and 0 < window - a and has[window - a]]
    often = lengths[np.argsort(-histogram[lengths], kind="stable")][:deepest]
    for a in often:
        rest = window - a - often
        ok = (rest > 0) & (often <= a)
        ok &= has[np.where(ok, rest, 0)] & (rest <= often)
        out += [(int(a), int(b), int(window - a - b)) for b in often[ok]]
    return out


def solve_counts(histogram: np.ndarray, combos: list[tuple[int, ...]], rounds: int = 60) -> np.ndarray:
    """Whole repeat counts x >= 0 with A x close to the histogram and never above it.

    Non-negative least squares by projected gradient steps with momentum, then rounding down, then one pass that uses what
    rounding left.
    """
    if not combos:
        return np.zeros(0, np.int64)
    column = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    length = np.concatenate([np.array(c) for c in combos])
    target = histogram.astype(float)
    uses = np.bincount(length, minlength=len(histogram)).astype(float)
    step = 1 / np.maximum(np.bincount(column, weights=uses[length], minlength=len(combos)), 1)  # a diagonal majoriser
    x = np.zeros(len(combos))
    y, t = x, 1.0
    for _ in range(rounds):
        slack = np.bincount(length, weights=y[column], minlength=len(histogram)) - target
        new = np.maximum(0, y - step * np.bincount(column, weights=slack[length], minlength=len(combos)))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = np.maximum(0, new + (last - 1) / t * (new - x))
        x = new
    counts = np.floor(x + 1e-9).astype(np.int64)
    left = histogram.tolist()
    order = np.argsort(-x, kind="stable")

    def take(k: int, most: int | None) -> int:
        """Uses combination ``k`` as often as what is left allows, ``most`` times at most."""
        combo = combos[k]
        fit = min(left[n] // combo.count(n) for n in combo)
        fit = fit if most is None else min(fit, most)
        for n in combo:
            left[n] -= fit
        return fit

    for k in order[counts[order] > 0].tolist():  # rounding and over-use are settled here
        counts[k] = take(k, int(counts[k]))
    # What is left only shrinks: a combination that lacks a length now never fits again.
    lacks = np.bincount(column[(np.array(left) == 0)[length]], minlength=len(combos)) > 0
    for k in order[~lacks[order]].tolist():
        counts[k] += take(k, None)
    return counts


def pack(sizes: np.ndarray, window: int, deepest: int = 400) -> np.ndarray:
    """Rows (document, start, length, sequence, offset) for documents of ``sizes`` tokens.

    Full windows of a document stand alone. The remainders' histogram goes to the solver. What is left is laid end to end
    and cut at the window; its last, partial window is cut at powers of two, which need no padding.
    """
    doc = np.arange(len(sizes))
    full = sizes // window
    owner = np.repeat(doc, full)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
    pieces = [np.stack([owner, nth * window, np.full(len(owner), window), np.arange(len(owner)), np.zeros(len(owner), np.int64)], axis=1)]
    sequence = len(owner)
    rest = sizes - full * window
    order = np.argsort(rest, kind="stable")
    order = order[rest[order] > 0]
    histogram = np.bincount(rest[order], minlength=window + 1)
    first = np.concatenate([[0], np.cumsum(histogram)])[:-1]  # of each length, in ``order``
    taken = np.zeros(window + 1, np.int64)
    combos = combinations(histogram, window, deepest)
    for combo, times in zip(combos, solve_counts(histogram, combos), strict=True):
        if not times:
            continue
        ids, at = sequence + np.arange(times), 0
        for n in combo:
            who = order[first[n] + taken[n] : first[n] + taken[n] + times]
            taken[n] += times
            pieces.append(np.stack([who, full[who] * window, np.full(times, n), ids, np.full(times, at)], axis=1))
            at += n
        sequence += int(times)
    where = np.arange(len(order))
    left = order[where - first[rest[order]] >= taken[rest[order]]]
    end = np.cumsum(rest[left])
    total = int(end[-1]) if len(end) else 0
    cuts = list(range(window, total + 1, window))
    tail, at = total % window, total - total % window
    while tail:
        at += 1 << (tail.bit_length() - 1)
        cuts.append(at)
        tail -= 1 << (tail.bit_length() - 1)
    cuts = np.array(cuts, np.int64)
    begin = end - rest[left]
    begins = np.union1d(begin, cuts[:-1]) if total else begin
    ends = np.append(begins[1:], total) if total else begins
    who = np.searchsorted(end, begins, side="right")
    into = np.searchsorted(cuts, begins, side="right")
    from_ = np.concatenate([[0], cuts])[into] if total else begins
    pieces.append(np.stack([left[who], full[left[who]] * window + begins - begin[who], ends - begins, sequence + into, begins - from_], axis=1))
    return np.concatenate(pieces).astype(np.int64)


def pack_documents(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, deepest: int = 400) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's, then ``end_id``; null text counts as empty, so it is one token. Documents are packed
    in lots of LOT_TOKENS within a task: every lot solves its own histogram, no rows move between tasks, and at most the
    few shorter sequences at a lot's end are not full. sequence_id is unique over all lots. Combinations of three lengths are
    formed from a lot's ``deepest`` most frequent lengths; a smaller number costs no padding, as what no combination takes is
    laid end to end, but cuts more documents. Repeated rows are packed each
    for itself; no rows give no pieces; other columns are ignored.
    """

    def lot(parts: list[tuple[pa.Array, list[bytes]]], base: int) -> pa.RecordBatch:
        doc_id = pa.concat_arrays([d for d, _ in parts])
        raw = [r for _, rs in parts for r in rs]
        sizes = np.array([len(r) // 4 for r in raw], np.int64)
        out = pack(sizes, window, deepest)
        crc = [zlib.crc32(raw[d][4 * s : 4 * (s + n)]) for d, s, n in out[:, :3].tolist()]
        columns = [doc_id.take(pa.array(out[:, 0])), out[:, 1], out[:, 2], np.array(crc, np.int64), sizes[out[:, 0]], base + out[:, 3], out[:, 4]]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = encoder(path), np.array([end_id], "<u4").tobytes()
        base, held, parts = TaskContext.get().partitionId() << 40, 0, []
        for part in slices(batches, "text"):
            raw = [r + end for r in bpe.encode(texts_of(part))]
            parts.append((part.column("doc_id"), raw))
            held += sum(map(len, raw)) // 4
            if held >= LOT_TOKENS:
                yield (made := lot(parts, base))
                base, held, parts = int(np.max(made.column("sequence_id").to_numpy())) + 1, 0, []
        if parts:
            yield lot(parts, base)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, _SCHEMA)

"""Periodic runs of words by block convolution.

A run is a maximal stretch of words with smallest period q and length of at least max(24, 3 * q). Texts are cut into blocks at
dyadic scales. For a period q from B to 2 * B - 1, the stretch of words that equal the word q later is at least 2 * B - 1 long
and so holds a whole block of B words; the sum of squared differences between that block and the window it is held against is
zero at distance q. These sums come from exact integer number-theoretic transforms, for all blocks of many texts and all
distances at once. A zero gives a distance, and the distance is extended to both sides.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cartolake.llm.kernel import U64, mix, powers
from cartolake.llm.shared import as_bytes, mapped

#: A prime with 2**20 as a divisor of one less, and a primitive root of it. Residues are kept between -P/2 and P/2 in doubles:
#: sums of 128 products stay below 2**53, so matrix products are exact.
P, ROOT = 13 * 2**20 + 1, 15
#: The shortest and the longest block. Longer periods are met by the longest blocks in later windows.
FIRST, TOP = 8, 1 << 14
LEAST, REPEATS = 24, 3
#: Numbers that a transform holds at once.
CELLS = 1 << 20
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo P, in place, between -P/2 and P/2."""
    x -= np.rint(x * (1 / P)) * P
    return x


@lru_cache(None)
def roots(n: int) -> np.ndarray:
    """The powers of an n-th root of unity."""
    out, step = np.ones(1, np.int64), pow(ROOT, (P - 1) // n, P)
    while len(out) < n:
        out = np.concatenate([out, out * pow(step, len(out), P) % P])
    return reduced(out.astype(np.float64))


@lru_cache(None)
def matrix(n: int, columns: int) -> np.ndarray:
    """Powers of the root for each place (row) and frequency (column)."""
    return roots(n)[np.outer(np.arange(n), np.arange(columns)) % n]


def ntt(x: np.ndarray, n: int) -> np.ndarray:
    """Transforms of length ``n`` (a power of two) of the rows of ``x``; columns that are missing are zero."""
    rows, given = x.shape
    if n <= 128:
        return reduced(x @ matrix(n, n)[:given])
    inner = n // 64
    outer = reduced(np.matmul(matrix(64, 64)[:, : given // inner], x.reshape(rows, given // inner, inner)))
    outer *= matrix(n, 64)[:inner].T
    found = ntt(reduced(outer).reshape(rows * 64, inner), inner)
    return np.ascontiguousarray(found.reshape(rows, 64, inner).transpose(0, 2, 1)).reshape(rows, n)


def digits(ids: np.ndarray, block: int) -> np.ndarray:
    """``ids`` in a base in which the squared differences over a block sum to less than P; a row per digit."""
    most, count = int(ids.max()) + 1, 1
    while True:
        base = max(2, int(most ** (1 / count)) - 1)
        while base**count < most:
            base += 1
        if count * block * (base - 1) ** 2 < P:
            break
        count += 1
    out, rest = np.empty((count, len(ids))), ids
    for i in range(count):
        out[i], rest = rest % base, rest // base
    return out


def zero_distances(planes: np.ndarray, block: int, steps: range) -> tuple[np.ndarray, np.ndarray]:
    """(block number, distance) of every block that occurs again, whole, at ``steps`` blocks' distance and less than a block more.

    ``planes``: digits by blocks by places. Blocks after the last are zeros, so occurrences there are for the caller to drop.
    """
    count, blocks, n = len(planes), planes.shape[1], 2 * block
    halo = max(steps) + 1
    per = max(halo, CELLS // (n * count))
    back, sign = -np.arange(n) % n, np.where(np.arange(n) % 2, -1.0, 1.0)
    twice = float(2 * pow(n, -1, P) % P)
    numbers, distances = [], []
    for first in range(0, blocks, per):
        last = min(first + per, blocks)
        held = np.zeros((count, last - first + halo, block))
        part = planes[:, first : last + halo]
        held[:, : part.shape[1]] = part
        squares = np.concatenate([[0.0], np.cumsum((held**2).sum(axis=0).ravel())])
        spectra = ntt(held.reshape(-1, block), n).reshape(count, -1, n)
        turned = spectra[:, : last - first, back]
        starts = np.arange(last - first) * block
        own = (squares[starts + block] - squares[starts])[:, None]
        for step in steps:
            window = spectra[:, step : step + last - first] + sign * spectra[:, step + 1 : step + 1 + last - first]
            product = reduced((turned * window).sum(axis=0))
            crossed = product @ matrix(n, n)[:, back[:block]] if n <= 128 else ntt(product, n)[:, back[:block]]
            if n <= 128:
                reduced(crossed)
            at = starts[:, None] + step * block + np.arange(block)
            other = squares[at + block] - squares[at]
            number, shift = np.nonzero(reduced(own + other - twice * crossed) == 0)
            keep = shift + step > 0
            numbers.append(number[keep] + first)
            distances.append(shift[keep] + step * block)
    return np.concatenate(numbers), np.concatenate(distances)


def reach(sums: np.ndarray, a: np.ndarray, d: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """For each place ``a``, how many words on from there (or back) equal the words ``d`` later, ``most`` at most."""
    up = powers(len(sums))[0]
    low, high = np.zeros_like(a), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        s, e = (a - mid, a) if back else (a, a + mid)
        same = (sums[e] - sums[s]) * up[d] == sums[e + d] - sums[s + d]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def walk(x: np.ndarray, place: int, d: int) -> tuple[int, int]:
    """Start and end of the stretch around ``place`` that has period ``d``, word by word."""
    s = e = place
    while s > 0 and x[s - 1] == x[s - 1 + d]:
        s -= 1
    while e + d < len(x) and x[e] == x[e + d]:
        e += 1
    return s, e + d


def candidates(ids: np.ndarray, at: np.ndarray, block: int) -> list[np.ndarray]:
    """Text, first place, end (of the places that equal the word a distance later) and distance of groups of neighbouring
    blocks that occur again at one distance, where a run may be."""
    sizes = np.diff(at)
    texts = np.flatnonzero(sizes >= max(LEAST, REPEATS * block))
    if not len(texts):
        return [np.zeros(0, np.int64)] * 4
    n = sizes[texts]
    blocks = -(-n // block)
    base = np.concatenate([[0], np.cumsum(blocks)])
    planes = digits(ids, block)
    held = np.zeros((len(planes), base[-1] * block))
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    held[:, np.repeat(base[:-1] * block, n) + within] = planes[:, np.repeat(at[texts], n) + within]
    steps = range(0 if block == FIRST else 1, 1 + (1 if block < TOP else max(1, int(n.max()) // REPEATS // TOP)))
    number, d = zero_distances(held.reshape(len(planes), -1, block), block, steps)
    of = np.searchsorted(base, number, side="right") - 1
    place = (number - base[of]) * block
    keep = (place + d + block <= n[of]) & (REPEATS * d <= n[of])
    number, d, of, place = number[keep], d[keep], of[keep], place[keep]
    order = np.lexsort((number, d))
    number, d, of, place = number[order], d[order], of[order], place[order]
    fresh = np.ones(len(d), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (number[1:] != number[:-1] + 1) | (of[1:] != of[:-1])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(d)))
    long = (count + 2) * block - 2 + d[first] >= np.maximum(LEAST, REPEATS * d[first])
    first, count = first[long], count[long]
    return [texts[of[first]], place[first], place[first] + count * block, d[first]]


def find_runs(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of every run, by text, start and period.

    ``ids``: small numbers that stand for the words (equal within a text for equal words only), texts end to end; ``at``:
    where each text begins, and the end.
    """
    sizes = np.diff(at)
    found, block = [], FIRST
    while len(sizes) and block <= TOP and max(LEAST, REPEATS * block) <= sizes.max():
        text, place, end, d = candidates(ids, at, block)
        found.append(np.stack([text, place, end, d, np.full_like(text, block)]))
        block *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 4
    text, place, end, d, block = np.concatenate(found, axis=1)
    sums = np.zeros(len(ids) + 1, U64)
    np.cumsum(mix(ids.astype(U64) + U64(1)) * powers(len(ids) + 1)[0][:-1], out=sums[1:])
    n, begin = sizes[text], at[text]
    # The next block does not match, so less than a block is left on either side.
    left = reach(sums, begin + place, d, np.minimum(block, place), back=True)
    right = reach(sums, begin + end, d, np.minimum(block, n - d - end), back=False)
    start, stop = place - left, end + right + d
    # Hashes found the ends; where the words say otherwise, all stretches of that text are walked word by word.
    order, first = _primitive(text, start, stop, d)
    doubted = {int(text[i]) for i in order[first] if not _holds(ids[at[text[i]] : at[text[i] + 1]], int(start[i]), int(stop[i]), int(d[i]))}
    if doubted:
        for i in np.flatnonzero(np.isin(text, list(doubted))):
            start[i], stop[i] = walk(ids[at[text[i]] : at[text[i] + 1]], int(place[i]), int(d[i]))
        order, first = _primitive(text, start, stop, d)
    keep = order[first]
    keep = keep[stop[keep] - start[keep] >= np.maximum(LEAST, REPEATS * d[keep])]
    keep = keep[np.lexsort((d[keep], start[keep], text[keep]))]
    return text[keep], start[keep], stop[keep] - start[keep], d[keep]


def _primitive(text: np.ndarray, start: np.ndarray, stop: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the stretches, and which in it have the smallest distance of those with the same ends and are long enough.

    A multiple of a run's period has the run's own ends, as the words just outside break both."""
    order = np.lexsort((d, stop, start, text))
    order = order[stop[order] - start[order] >= np.maximum(LEAST, REPEATS * d[order])]
    first = np.ones(len(order), bool)
    key = np.stack([text[order], start[order], stop[order]])
    first[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
    return order, first


def _holds(x: np.ndarray, start: int, stop: int, d: int) -> bool:
    ends = (start == 0 or x[start - 1] != x[start - 1 + d]) and (stop == len(x) or x[stop] != x[stop - d])
    return ends and np.array_equal(x[start : stop - d], x[start + d : stop])


def numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text (bytes without ASCII white space between), their numbers within it, and where texts begin."""
    words, ids, at = [], [], [0]
    for t in texts:
        own = t.split()
        seen: dict[bytes, int] = {}
        ids += [seen.setdefault(w, len(seen)) for w in own]
        words.append(own)
        at.append(len(ids))
    return words, np.array(ids, np.int64), np.array(at, np.int64)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, runs (array of start, length and period in words, by start, then period), collapsed.

    ``collapsed`` is the text's words, joined by one space, without those that a run holds after its first period. Words are
    stretches without ASCII white space. Null and empty texts have no runs and collapse to an empty string; repeated rows
    each get a row; no rows give none; other columns of ``docs`` are ignored.
    """

    def make(part: pa.RecordBatch) -> list:
        words, ids, at = numbered(as_bytes(part.column("text")).to_pylist())
        text, start, length, period = find_runs(ids, at)
        step = np.zeros(len(ids) + 1, np.int32)
        np.add.at(step, at[text] + start + period, 1)
        np.add.at(step, at[text] + start + length, -1)
        gone = np.cumsum(step)[:-1] > 0
        held = set(text.tolist())
        kept = [[w for w, g in zip(own, gone[at[i] : at[i + 1]], strict=True) if not g] if i in held else own for i, own in enumerate(words)]
        ends = np.searchsorted(text, np.arange(len(words) + 1)).astype(np.int32)
        runs = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], fields=list(RUNS.value_type))
        return [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), runs, type=RUNS), pa.array([b" ".join(k).decode() for k in kept], pa.string())]

    schema = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return mapped(docs.select("doc_id", "text"), "text", schema, ["doc_id", "runs", "collapsed"], make)

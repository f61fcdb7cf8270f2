"""Vectorised text primitives over the joined bytes of many documents.

All hashes are 64-bit: a substring's hash is a polynomial over random byte values modulo 2**64, taken from prefix
sums, then mixed. They are the same in every process and on every machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cartolake.llm.shared import as_bytes

U64 = np.uint64
#: Bases of two independent hashes.
BASES = (0x9E3779B97F4A7C15, 0xA0761D6478BD642F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def powers(n: int, base: int = BASES[0]) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) < n:
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(max(n, 1 << 20), b, dtype=U64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers[base] = tuple(made)
    up, down = _powers[base]
    return up[:n], down[:n]


class Joined:
    """Bytes of a column's texts end to end; ``at`` holds where each begins, with the total at the end."""

    def __init__(self, texts: pa.Array, lower: bool = False, base: int = BASES[0]):
        self.base = base
        array = as_bytes(texts)
        offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
        data = array.buffers()[2]
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        if lower:
            self.data = LOWER[self.data]
        self.at = offsets - offsets[0]
        self.n = len(array)
        self._sums: np.ndarray | None = None

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A mixed hash of each byte range."""
        if self._sums is None:
            up, _ = powers(len(self.data) + 1, self.base)
            self._sums = np.zeros(len(self.data) + 1, dtype=U64)
            np.cumsum(mix(BYTE_VALUE * U64(self.base))[self.data] * up[:-1], out=self._sums[1:])
        _, down = powers(len(self.data) + 1, self.base)
        return mix((self._sums[end] - self._sums[start]) * down[start] + (end - start).astype(U64))

    def grams(self, k: int) -> np.ndarray:
        """A mixed hash of the ``k`` bytes from each place; ranges may run over into the next text."""
        n = len(self.data) - k + 1
        if n <= 0:
            return np.zeros(0, U64)
        self.hashes(np.zeros(0, np.int64), np.zeros(0, np.int64))
        return mix((self._sums[k:] - self._sums[:-k]) * powers(len(self.data) + 1, self.base)[1][:n])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every maximal run without ASCII white space, and at which word each text begins."""
        inside = ~IS_SPACE[self.data]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[self.at[:-1][self.at[:-1] < len(inside)]] = False
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        after[self.at[1:][self.at[1:] > 0] - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        return start, end, np.searchsorted(start, self.at)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of set flags in each text."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.at[1:]] - sums[self.at[:-1]]


def owner(at: np.ndarray) -> np.ndarray:
    """For each element, the group that holds it, given where groups begin."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def windows(values: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``k`` neighbouring values within a group, and the first value's place."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = np.zeros(n, U64)
    for i in range(k):
        h = (h ^ values[i : i + n]) * U64(0xD6E8FEB86659FD93)
        h ^= h >> U64(32)
    group = owner(at)
    place = np.flatnonzero(group[:n] == group[k - 1 :])
    return mix(h[place]), place


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """Which keys have occurred before."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = ranked[1:] == ranked[:-1]
    return out


def in_group(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal values of the same group."""
    return mix(values ^ mix(group.astype(U64) + U64(0x632BE59BD9B4E019)))

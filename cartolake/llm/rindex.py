"""Removal of long repeated passages with run-length Burrows-Wheeler indexes.

1. Anchors: in every window of LENGTH bytes the gram with the least hash is chosen, so equal windows choose it at the same
   place. An anchor's context is all that such a window can reach around it.
2. An anchor whose whole context occurs earlier has all its windows marked; this settles the inside of copies, first
   within a task and then over all anchors of one hash. Grams and contexts have independent 64-bit hashes.
3. What is left of an anchor hash are contexts that differ somewhere (the edges of copies). They are brought together by
   hash, PER_INDEX at a time, and each bucket of them gets a run-length index: matching statistics are streamed from its
   sampled run ends, and windows that an earlier context also has are marked.
4. A hash with more contexts is spread over several indexes. Of each of its windows an index passes on one place, the
   earliest; these meet by window digest in a grouped aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.llm.kernel import BASES, U64, Joined, in_group, later, mix
from cartolake.llm.shared import as_bytes, forget, mapped, slices, stored

GRAM = 32
#: Windows whose anchors are chosen at a time.
BLOCK = 1 << 18
#: Contexts of an index.
PER_INDEX = 2600
#: A gram that this many contexts of one slice share is crowded; of all crowded grams the MOST_CROWDED are dealt out by
#: gram and context. Any other gram has less than that share of the rows.
CROWD = 16
MOST_CROWDED = 1000


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of several texts, sampled at the ends of its runs.

    Texts end in terminators that are smaller than any byte and ordered by text. ``letters`` and ``starts`` hold the runs,
    ``steps`` the row that each run's first row leads to, ``heads`` the text position of each run's first row and ``shared``
    what its suffix has in common with the row before. Suffix order is only there while the index is built.
    """

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.n = int(self.sizes.sum() + len(texts))
        self.begin = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.text = np.repeat(np.arange(len(texts)), self.sizes + 1)
        self.left = np.repeat(self.begin + self.sizes, self.sizes + 1) - np.arange(self.n)  # bytes up to the terminator
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        rows, levels = self._sorted(data)
        before = np.where(rows == self.begin[self.text[rows]], -1 - self.text[rows], data[rows - 1].astype(np.int64))
        self.starts = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        self.letters = before[self.starts]
        self.heads = rows[self.starts]
        tails = rows[np.append(self.starts[1:], self.n) - 1]
        self.shared = np.append(0, self._common(data, levels, tails[:-1], self.heads[1:]))
        # Rows of a letter follow those of all smaller ones, in the order of its runs.
        order = np.argsort(self.letters, kind="stable")
        lengths = np.diff(np.append(self.starts, self.n))[order]
        within = np.cumsum(lengths) - lengths
        self.steps = np.empty(len(order), np.int64)
        self.steps[order] = within

    def _sorted(self, data: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffix order by doubling, with the ranks of prefixes of each length on the way."""
        place, longest = np.arange(self.n), int(self.sizes.max(initial=0))
        key = np.zeros(self.n, np.int64)
        for i in range(7):
            at = np.minimum(place + i, self.n - 1)
            key = key * 257 + np.where(self.left > i, data[at].astype(np.int64) + 1, 0)
        rank, k = np.unique(key, return_inverse=True)[1] + (key.min(initial=1) > 0), 7
        levels = [(k, rank)]
        while k < longest:
            ahead = np.where(self.left > k, rank[np.minimum(place + k, self.n - 1)] + 1, 0)
            rank, k = np.unique(rank.astype(np.int64) * (self.n + 2) + ahead, return_inverse=True)[1], 2 * k
            levels.append((k, rank))
        return np.argsort(rank, kind="stable"), levels

    def _common(self, data: np.ndarray, levels: list[tuple[int, np.ndarray]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``x`` and ``y``."""
        most = np.minimum(self.left[x], self.left[y])
        out = np.zeros(len(x), np.int64)
        for k, rank in reversed(levels):
            a, b = (np.minimum(z + out, self.n - 1) for z in (x, y))
            same = (out < most) & (rank[a] == rank[b])
            out[same] += k
        for _ in range(6):
            a, b = (np.minimum(z + out, self.n - 1) for z in (x, y))
            out[(out < most) & (data[a] == data[b])] += 1
        return np.minimum(out, most)

    def matching_statistics(self) -> np.ndarray:
        """For every text position, the length it has in common with the row before its own.

        Within a run the value falls by one from the position before, so only the samples at run heads are taken, and the
        rest is streamed in text order.
        """
        reach = np.zeros(self.n, np.int64)
        reach[self.heads] = self.shared + self.heads
        return np.maximum(np.maximum.accumulate(reach) - np.arange(self.n), 0)

    def walk(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, rows), a step at a time: all texts backwards from their terminators, each row led to by the one before."""
        texts = np.arange(len(self.sizes))
        row, at = texts.copy(), self.begin + self.sizes
        while len(texts):
            yield at, row
            more = at > self.begin[texts]
            texts, row, at = texts[more], row[more], at[more] - 1
            run = np.searchsorted(self.starts, row, side="right") - 1
            row = self.steps[run] + row - self.starts[run]

    def first_of(self, order: np.ndarray, length: int) -> np.ndarray:
        """For every position, the least ``order`` among positions with the same ``length`` bytes; -1 near a text's end."""
        rows = np.empty(self.n, np.int32)
        for at, row in self.walk():
            rows[at] = row
        new = np.zeros(self.n, np.int32)
        new[rows] = self.matching_statistics() < length
        group = np.cumsum(new, dtype=np.int32)
        of = group[rows]
        least = np.full(int(group[-1]) + 1 if self.n else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, of, order)
        out = least[of]
        out[self.left < length] = -1
        return out


def _chosen(data: np.ndarray, at: np.ndarray, begin: int, end: int, length: int) -> tuple[np.ndarray, ...]:
    """Of the windows that start from ``begin`` to before ``end``: per choice of an anchor its text, place in ``data``, hash,
    hash of its context, and first and last window. Hashes do not depend on where the piece of ``data`` is cut."""
    low = max(begin - length, 0)
    piece = pa.array([data[low : end + 2 * length].tobytes()], pa.large_binary())  # what contexts can reach
    grams = Joined(piece).grams(GRAM)[begin - low : end - low + length - GRAM]
    least = (grams & ~U64(0xFFFFFFFF)) | np.arange(len(grams), dtype=U64)
    wide, step = length - GRAM + 1, 1
    while 2 * step <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < wide:
        least = np.minimum(least[: len(least) - (wide - step)], least[wide - step :])
    window = np.arange(begin, end)
    text = np.searchsorted(at, window, side="right") - 1
    inside = window + length <= at[text + 1]
    window, text, chosen = window[inside], text[inside], (least[inside] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1]))[: len(window)])
    last = window[np.append(new[1:], len(window))[: len(new)] - 1]
    found, text = grams[chosen[new]].view(np.int64), text[new]
    chosen = chosen[new] + begin
    left, right = np.maximum(at[text], chosen + GRAM - length), np.minimum(at[text + 1], chosen + length)
    context = Joined(piece, base=BASES[1]).hashes(left - low, right - low) ^ mix((chosen - left).astype(U64) * U64(1009) + (right - chosen).astype(U64))
    return text, chosen, found, context.view(np.int64), window[new], last


def _anchors(texts: pa.Array, length: int, block: int = BLOCK) -> dict[str, np.ndarray]:
    """Per anchor: text number, place in it, hash, hash of its context, and first and last window that chose it.

    Windows are taken ``block`` at a time, as hashes and choices take many times the bytes of the texts, and anchors do not.
    """
    joined = Joined(texts)
    at, names = joined.at, ("text", "place", "hash", "context", "first", "last")
    windows = len(joined.data) - length + 1
    parts = [_chosen(joined.data, at, begin, min(begin + block, windows), length) for begin in range(0, windows, block)]
    if not parts:
        return {c: np.zeros(0, np.int64) for c in names}
    out = dict(zip(names, map(np.concatenate, zip(*parts, strict=True)), strict=True))
    # An anchor that windows of two blocks chose is one.
    new = np.flatnonzero(np.append(True, out["place"][1:] != out["place"][:-1])[: len(out["place"])])
    last = out["last"][np.append(new[1:], len(out["place"]))[: len(new)] - 1]
    out = {c: v[new] for c, v in out.items()} | {"last": last}
    base = at[out["text"]]
    return out | {c: out[c] - base for c in ("place", "first", "last")}


_FOUND = "kind int, hash long, context long, doc_id long, place long, first long, last long, crowd int"
_COLUMNS = [x.split()[0] for x in _FOUND.split(", ")]


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """Anchors that are the first of their context in a slice (kind 0), and window ranges already marked (kind 1). ``crowd``
    is the number of anchors of the same gram that a slice passes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            order = np.argsort(part.column("doc_id").to_numpy(zero_copy_only=False), kind="stable")
            part = part.take(pa.array(order))
            a = _anchors(part.column("text"), length)
            doc = part.column("doc_id").to_numpy(zero_copy_only=False)[a["text"]]
            seen = later(in_group(a["hash"].view(U64), a["context"]))
            # A copy of a row with the same doc_id is no earlier occurrence: such places go on to be compared by place.
            same_doc = np.zeros(part.num_rows, bool)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            same_doc[1:] = ids[1:] == ids[:-1]
            seen &= ~same_doc[a["text"]]
            kept = ~seen
            put = lambda kind, rows, crowd: pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(rows["doc"]), kind, np.int32), rows["hash"], rows["context"], rows["doc"], rows["place"], rows["first"], rows["last"], crowd.astype(np.int32))], _COLUMNS)
            own, of, size = np.unique(a["hash"][kept], return_inverse=True, return_counts=True)
            yield put(0, {c: v[kept] for c, v in (a | {"doc": doc}).items()}, size[of])
            m = {c: v[seen] for c, v in (a | {"doc": doc}).items()}
            if len(m["doc"]):
                new = np.flatnonzero(np.append(True, (m["text"][1:] != m["text"][:-1]) | (m["first"][1:] != m["last"][:-1] + 1)))
                end = np.append(new[1:], len(m["doc"])) - 1
                zero = np.zeros(len(new), np.int64)
                yield put(1, {"hash": zero, "context": zero, "doc": m["doc"][new], "place": zero, "first": m["first"][new], "last": m["last"][end]}, zero)

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, _FOUND)


def settle(found: DataFrame) -> DataFrame:
    """(kind, hash, doc_id, place, first, last): kind 1 are marked ranges; kind 2 are the first anchors of their contexts,
    where their hash has several.

    Anchors are dealt by hash, those of the most crowded grams by hash and context, so a frequent gram is no single task's.
    """
    crowded = found.where(F.col("crowd") >= CROWD).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    crowded = crowded.orderBy(F.desc("n"), "hash").limit(MOST_CROWDED).select("hash", F.lit(True).alias("several"))
    rows = found.select("hash", "context", "doc_id", "place", "first", "last").join(F.broadcast(crowded), "hash", "left")  # at most MOST_CROWDED rows
    # One row per slice and context arrives here, as slices keep only their first.
    deal = F.when(F.col("several"), F.xxhash64("hash", "context")).otherwise(F.col("hash"))
    dealt = rows.withColumn("several", F.coalesce("several", F.lit(False))).repartition(deal).sortWithinPartitions("hash", "context", "doc_id", "place")
    names = ["kind", "hash", "doc_id", "place", "first", "last"]

    def put(table: dict[str, np.ndarray], pick: np.ndarray, kind: int) -> pa.RecordBatch:
        own = [table[c][pick] for c in names[1:]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(pick), kind, np.int32), *own)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams over sorted rows. Of the hash at hand it holds the first anchor of the last context, and as long as it is
        the only one, whether it has been passed on."""
        last: dict[str, np.ndarray] | None = None
        passed = False
        for batch in batches:
            t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            if last is not None:
                t = {c: np.concatenate([last[c], t[c]]) for c in t}
            if not len(t["hash"]):
                continue
            same = np.append(False, (t["hash"][1:] == t["hash"][:-1]) & (t["context"][1:] == t["context"][:-1]))
            # The first row of the same context has an earlier (doc_id, place), unless a row repeats a doc_id.
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
            alike = same & (t["doc_id"] == t["doc_id"][lead]) & (t["place"] == t["place"][lead])
            yield put(t, np.flatnonzero(same & ~alike), 1)
            t = {c: v[~same] for c, v in t.items()}
            hashes = t["hash"]
            new = np.append(True, hashes[1:] != hashes[:-1])
            mine = np.cumsum(new) - 1
            several = (np.bincount(mine) > 1)[mine] | t["several"]
            if passed:  # the first row was passed on before, and more of its hash may follow
                several[mine == 0] = True
            out = several.copy()
            out[0] &= not passed
            yield put(t, np.flatnonzero(out), 2)
            passed = bool(several[-1])
            last = {c: v[-1:] for c, v in t.items()}

    return dealt.mapInArrow(run, "kind int, hash long, doc_id long, place long, first long, last long")


def contexts(docs: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """The bytes around each open anchor, with the place where they begin and the number of indexes that its hash has."""
    count = open_.groupBy("hash").agg(F.ceil(F.count(F.lit(1)) / PER_INDEX).cast("int").alias("parts"))
    known = open_.join(count, "hash").select("doc_id", F.struct("hash", "place", "first", "last", "parts").alias("a"))
    per_doc = known.groupBy("doc_id").agg(F.collect_list("a").alias("own"))  # a document's own anchors
    both = docs.select("doc_id", "text").join(per_doc, "doc_id")
    names = ["hash", "doc_id", "start", "first", "last", "parts", "body"]

    def make(part: pa.RecordBatch) -> list:
        out: list[tuple] = []
        for doc, text, own in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text")).to_pylist(), part.column("own").to_pylist(), strict=True):
            for a in own:
                low = max(0, a["place"] + GRAM - length)
                out.append((a["hash"], doc, low, a["first"], a["last"], a["parts"], text[low : a["place"] + length]))
        columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
        return [*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())]

    return mapped(both, "text", "hash long, doc_id long, start long, first long, last long, parts long, body binary", names, make)


def index_marks(around: DataFrame, length: int) -> DataFrame:
    """(doc_id, first, last, digest) from run-length indexes over buckets of contexts: without digest a range of windows that
    an earlier context of the bucket also has; with digest the earliest window of its bytes, where other indexes hold
    contexts of the same hash."""
    rows = around.withColumn("part", F.pmod(F.xxhash64("body"), "parts"))
    dealt = rows.repartition("hash", "part").sortWithinPartitions("hash", "part", "doc_id", "start")
    names, per = ["doc_id", "first", "last", "digest"], PER_INDEX

    def index(part: pa.Table) -> pa.RecordBatch:
        column = {c: part.column(c).to_numpy() for c in ("doc_id", "start", "first", "last", "parts")}
        bodies = part.column("body").to_pylist()
        built = RunLengthIndex(bodies)
        text = built.text
        where = column["start"][text] + np.arange(built.n) - built.begin[text]
        docs, number = np.unique(column["doc_id"], return_inverse=True)
        order = (number[text].astype(np.int64) << 40) + where
        least = built.first_of(order, length)
        own = (least >= 0) & (where >= column["first"][text]) & (where <= column["last"][text])
        at = np.flatnonzero(own & (least < order))
        new = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]]))) if len(at) else at
        end = at[np.append(new[1:], len(at)) - 1] if len(at) else at
        ahead = np.flatnonzero(own & (least == order) & (column["parts"][text] > 1))
        digests = [hashlib.blake2b(bodies[t][p : p + length], digest_size=16).digest() for t, p in zip(text[ahead].tolist(), (ahead - built.begin[text[ahead]]).tolist(), strict=True)]
        columns = [np.concatenate(x) for x in ((docs[number[text[at[new]]]], docs[number[text[ahead]]]), (where[at[new]], where[ahead]), (where[end], where[ahead]))]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([None] * len(new) + digests, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 2 * per:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            hashes, parts = table.column("hash").to_numpy(), table.column("part").to_numpy()
            ends = np.append(np.flatnonzero((hashes[1:] != hashes[:-1]) | (parts[1:] != parts[:-1])) + 1, len(hashes))
            start = 0
            for end, after in zip(ends[:-1], ends[1:], strict=True):
                if after - start > per or after == len(hashes):
                    yield index(table.slice(start, end - start))
                    start = int(end)
            held = table.slice(start).to_batches()
        if held and sum(b.num_rows for b in held):
            yield index(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(run, "doc_id long, first long, last long, digest binary")


def meet(ahead: DataFrame) -> DataFrame:
    """(doc_id, first, last) of windows from several indexes that are not the earliest of their digest."""
    least = ahead.groupBy("digest").agg(F.min(F.struct("doc_id", "first")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return ahead.join(least, "digest").where(F.struct("doc_id", "first") > F.col("least")).select("doc_id", "first", "last")


def repeat_marks(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, first, last): ranges of places where a window of ``length`` bytes starts that also starts earlier."""
    ranges = ["doc_id", "first", "last"]
    found = stored(anchors(docs, length), "anchors")
    settled = stored(settle(found.where("kind = 0")), "settled")
    copied = stored(found.where("kind = 1").select(ranges), "copied")
    forget(found)  # nearly all of it are anchors, which are settled
    around = contexts(docs, settled.where("kind = 2"), length)
    indexed = stored(index_marks(around, length), "indexed")
    marks = [copied, settled.where("kind = 1"), indexed.where("digest is null"), meet(indexed.where("digest is not null"))]
    return reduce(DataFrame.union, [m.select(ranges) for m in marks])


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    A byte goes if a window of ``length`` bytes that covers it also starts earlier: in a smaller doc_id, or earlier in the
    same document. Windows never cross documents; windows are judged on the input. Null text counts as empty, and shorter
    texts keep everything. Rows that repeat a doc_id are the same document: a window at the same place is no earlier one.
    Rows without doc_id keep everything. No rows give none; other columns are ignored.
    """
    marks = repeat_marks(docs, length).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("own"))  # a document's own ranges
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]

    def make(part: pa.RecordBatch) -> list:
        out = []
        own = part.column("own")
        ranges = own.flatten()
        first, last = (ranges.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        size = np.diff(own.offsets.to_numpy()) if len(own) else np.zeros(0, np.int64)
        size = np.where(own.is_null().to_numpy(zero_copy_only=False), 0, size)
        ends = np.cumsum(size)
        for i, text in enumerate(as_bytes(part.column("text")).to_pylist()):
            if not size[i]:
                out.append((len(text), 0, 0, text))
                continue
            edge = np.zeros(len(text) + 1, np.int64)
            mine = slice(ends[i] - size[i], ends[i])
            np.add.at(edge, first[mine], 1)
            np.add.at(edge, last[mine] + length, -1)
            gone = np.cumsum(edge)[:-1] > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())]

    both = docs.select("doc_id", "text").join(marks, "doc_id", "left")
    return mapped(both, "text", "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", names, make)

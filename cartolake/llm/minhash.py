"""Near-duplicate components by an inverted join over MinHash signature coordinates.

1. Every document's distinct shingles give a signature; documents with equal sets share one vertex (their least doc_id).
2. Vertices are posted under each (coordinate, value) pair. A pair of documents needs MATCHES colliding coordinates, so with
   posts ordered from rare to frequent each document is posted only under its first ``shared - MATCHES + 1`` shared pairs
   (prefix), and not at all with fewer than MATCHES shared pairs. The frequent lists that the prefix leaves out are not
   merged (skipped) but probed: a candidate's collisions are counted over all coordinates.
3. Each list is merged with its most central member first. Lists whose members have then come together in one component
   are done; in the others only members of different components are compared, block against block, each pair in the first
   list that it shares. Pairs with fewer than MATCHES collisions are dropped, the others are held against their full sets
   in the same task, so only links leave it.
4. Every link stands on full shingle sets before it joins components.

A pair at the threshold is missed with a probability of about 5e-5 (64 coordinates, 34 matches, similarity 0.75; 3e-7 at
0.8); groups of more than two are mostly held together by other links as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.llm.kernel import U64, Joined, in_group, later, mix, owner, windows
from cartolake.llm.shared import bit_marked, forget, mapped, stored, text_or_empty

COORDINATES = 64
BLOCK = 2048
#: Hashes of a set that go to a block comparison; of a larger set a fixed share of the hash range, and its links are
#: confirmed on the texts.
SAMPLE = 1024
_XOR = mix(np.arange(1, COORDINATES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_ODD = mix(_XOR) | U64(1)


def matches_needed(percent: int) -> int:
    """Equal coordinates that two sets at the threshold fall short of with a probability of about 5e-5."""
    s = percent / 100
    return max(1, math.ceil(COORDINATES * s - 4.06 * math.sqrt(COORDINATES * s * (1 - s))))


def shingle_sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word-shingle hashes of each text, end to end, and where each text's begin.

    A-Z is lower-cased. A text with one to k - 1 words has its whole sequence as one shingle; without words it has none.
    """
    joined = Joined(texts, lower=True)
    start, end, first = joined.words()
    words = joined.hashes(start, end)
    count = np.diff(first)
    text_of_word = owner(first)
    found, doc = [], []
    for size in range(1, k + 1):
        hashes, place = windows(words, first, size)
        of = text_of_word[place]
        use = count[of] == size if size < k else np.ones(len(of), bool)
        found.append(hashes[use] + U64(size))
        doc.append(of[use])
    hashes, of = np.concatenate(found), np.concatenate(doc)
    if len(found) > 1 and len(of):
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
    new = ~later(in_group(hashes, of))
    hashes, of = hashes[new], of[new]
    return hashes, np.searchsorted(of, np.arange(joined.n + 1))


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The least hash of each set under each coordinate's permutation, as 32 bits; sets must not be empty."""
    out = np.empty((len(at) - 1, COORDINATES), np.uint32)
    for i in range(COORDINATES):
        out[:, i] = (np.minimum.reduceat((hashes ^ _XOR[i]) * _ODD[i], at[:-1]) >> U64(32)).astype(np.uint32)
    return out


def collisions(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One bit for each coordinate in which two rows of signatures agree, as a 64-bit number per pair."""
    return np.packbits(x == y, axis=1, bitorder="little").view("<u8").ravel()


def features(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, pick, n_shingles, set_a, set_b, signature): the set is known by two 64-bit sums; without shingles there is
    no signature. ``pick`` is a hash of the text."""

    def make(part: pa.RecordBatch) -> list:
        hashes, at = shingle_sets(part.column("text"), k)
        size = np.diff(at)
        has = size > 0
        sums = [np.concatenate([[U64(0)], np.cumsum(mix(hashes + U64(salt)))]) for salt in (1, 2)]
        keys = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
        made = iter(signatures(hashes, np.append(at[:-1][has], len(hashes))) if has.any() else [])
        raw = pa.array([next(made).tobytes() if h else None for h in has], pa.binary())
        return [part.column("doc_id"), part.column("pick"), np.asarray(size, np.int64), *keys, raw]

    names = ["doc_id", "pick", "n_shingles", "set_a", "set_b", "signature"]
    schema = "doc_id long, pick long, n_shingles long, set_a long, set_b long, signature binary"
    return mapped(docs.select("doc_id", "text", pick().alias("pick")), "text", schema, names, make)


def pick() -> F.Column:
    """Of rows that share a doc_id, the one with the greatest value stands for all."""
    return F.xxhash64(text_or_empty())


def _posts(vertices: DataFrame) -> DataFrame:
    """(post, v): one row per coordinate; a post is the coordinate and its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinate = np.arange(COORDINATES, dtype=np.int64) << 32
        for batch in batches:
            v = np.repeat(batch.column("v").to_numpy(zero_copy_only=False), COORDINATES)
            yield pa.RecordBatch.from_arrays([pa.array((_signs(batch).astype(np.int64) + coordinate).ravel()), pa.array(v)], ["post", "v"])

    return vertices.select("v", "signature").mapInArrow(run, "post long, v long")


def _signs(batch: pa.RecordBatch, column: str = "signature") -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint32).reshape(-1, COORDINATES)


def prefix_posts(vertices: DataFrame, percent: int) -> DataFrame:
    """(post, v, central): each vertex under its rarest shared posts, as many as the matches needed ask for. ``central``
    sums the sizes of all its shared lists: who agrees with most others has the most."""
    needed = matches_needed(percent)
    posts = _posts(vertices)
    shared = posts.groupBy("post").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = F.array_sort(F.collect_list(F.struct("n", "post")))  # COORDINATES at most
    mine = posts.join(shared, "post").groupBy("v").agg(own.alias("own"), F.sum("n").alias("central"))
    out = mine.where(F.size("own") >= needed).select("v", "central", F.explode(F.slice("own", 1, F.size("own") - needed + 1)).alias("o"))
    return out.select(F.col("o.post").alias("post"), "v", "central")


def star_pairs(prefix: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """Each list's members with its most central one, where sizes and the number of collisions allow the similarity."""
    hubs = prefix.groupBy("post").agg(F.max(F.struct("central", "v")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("post", F.col("hub.v").alias("hub"))
    pairs = prefix.join(hubs, "post").where("v <> hub").select(F.least("v", "hub").alias("a"), F.greatest("v", "hub").alias("b")).distinct()
    side = vertices.select("v", "n_shingles", "signature")
    both = pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    needed = matches_needed(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            enough = np.bitwise_count(collisions(_signs(batch, "sa"), _signs(batch, "sb"))) >= needed
            yield batch.select(["a", "b"]).filter(pa.array(enough))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def open_lists(prefix: DataFrame, labels: DataFrame) -> DataFrame:
    """(post, v, c): lists whose members are in several components ``c``."""
    # Lists with the same members ask the same questions: one of them is enough.
    alike = prefix.groupBy("post").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v").cast("decimal(20,0)")).alias("m")).where("n > 1")
    once = prefix.select("post", "v").join(alike.groupBy("n", "m").agg(F.min("post").alias("post")).select("post"), "post")
    known = once.join(labels, "v", "left").select("post", "v", F.coalesce("c", "v").alias("c"))
    mixed = known.groupBy("post").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
    return known.join(mixed.select("post"), "post")


def tiles(lists: DataFrame) -> DataFrame:
    """(post, x, y, side, v, c): every member of a list in each pair (x, y) of blocks that it is compared in.

    A component with more than BLOCK members in a list has blocks of its own, which are not compared with each other; all
    other members share light blocks.
    """
    family = lists.groupBy("post", "c").agg(F.count(F.lit(1)).alias("n")).withColumn("family", F.when(F.col("n") > BLOCK, F.col("c").cast("string")).otherwise("light"))
    parts = family.groupBy("post", "family").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts"))
    block = lambda part: F.concat_ws(":", "family", part)
    placed = lists.join(family.select("post", "c", "family"), ["post", "c"]).join(parts, ["post", "family"])
    placed = placed.select("post", "v", "c", block(F.pmod(F.xxhash64("v"), "parts")).alias("block"))
    blocks = parts.select("post", "family", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("post", "family", block(F.col("part")).alias("block"))
    x, y = blocks.toDF("post", "fx", "x"), blocks.toDF("post", "fy", "y")
    pairs = x.join(y, "post").where("x <= y and (fx <> fy or fx = 'light')").select("post", "x", "y")
    sides = pairs.select("*", F.lit(0).alias("side"), F.col("x").alias("block")).union(pairs.where("x < y").select("*", F.lit(1), "y"))
    return placed.join(sides, ["post", "block"]).select("post", "x", "y", "side", "v", "c")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text) of the wanted doc_ids, one row each."""
    found = likely(docs.select("doc_id", text_or_empty().alias("text")), wanted).join(wanted, "doc_id")
    return found.groupBy("doc_id").agg(F.max_by("text", pick()).alias("text"))


def sampled_sets(docs: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """(v, level, hashes): the sorted shingle hashes of each member of ``lists``, all of them at level 0, the least
    2**-level share of the hash range where more than SAMPLE would be left."""
    wanted, sample = lists.select(F.col("v").alias("doc_id")).distinct(), SAMPLE

    def make(part: pa.RecordBatch) -> list:
        hashes, at = shingle_sets(part.column("text"), k)
        level = [max(0, math.ceil(math.log2(n / sample))) if n else 0 for n in np.diff(at).tolist()]
        own = (np.sort(hashes[i:j]) for i, j in zip(at[:-1], at[1:], strict=True))
        raw = [h[: np.searchsorted(h, U64(1 << (64 - n)))].tobytes() if n else h.tobytes() for h, n in zip(own, level, strict=True)]
        return [part.column("doc_id"), pa.array(level, pa.int32()), pa.array(raw, pa.binary())]

    return mapped(_texts(docs, wanted), "text", "v long, level int, hashes binary", ["v", "level", "hashes"], make)


class _Sets:
    """Sampled sets of a block's members, for counts of common elements."""

    def __init__(self, raw: list[bytes], level: np.ndarray, percent: int):
        self.at = np.concatenate([[0], np.cumsum([len(r) // 8 for r in raw])])
        values, self.ids = np.unique(np.frombuffer(b"".join(raw), U64), return_inverse=True)
        self.level, self.share = level, percent / 100
        self.percent = percent
        self.marks = np.zeros(len(values), bool)
        #: By level: the first element outside its share of the range, and the sizes of all sets within it.
        self.under = {}
        for n in np.unique(level).tolist():
            end = len(values) if not n else int(np.searchsorted(values, U64(1 << (64 - n))))
            sums = np.concatenate([[0], np.cumsum(self.ids < end)])
            self.under[n] = (end, sums[self.at[1:]] - sums[self.at[:-1]])

    def linked(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs reach the similarity; ``x`` is sorted. Sampled sets get the benefit of chance (about 1e-5)."""
        out = np.zeros(len(x), bool)
        begins = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else []
        for begin, stop in zip(begins, np.append(begins[1:], len(x)), strict=True):
            a, others = x[begin], y[begin:stop]
            own = self.ids[self.at[a] : self.at[a + 1]]
            self.marks[own] = True
            size = self.at[others + 1] - self.at[others]
            ends = np.cumsum(size)
            theirs = self.ids[np.repeat(self.at[others] - ends + size, size) + np.arange(ends[-1])]
            level = np.maximum(self.level[a], self.level[others])
            hit = self.marks[theirs]
            self.marks[own] = False
            if level.any():
                hit &= theirs < np.repeat([self.under[n][0] for n in level.tolist()], size)
            sums = np.concatenate([[0], np.cumsum(hit)])
            common = sums[ends] - sums[ends - size]
            union = np.array([self.under[n][1][a] + self.under[n][1][b] for n, b in zip(level.tolist(), others.tolist(), strict=True)]) - common
            slack = np.where(level > 0, 4.2 * np.sqrt(union * self.share * (1 - self.share)), 0)
            out[begin:stop] = 100 * common >= self.percent * union - 100 * slack
        return out


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which links join what earlier ones have not joined yet."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.get(i, i)) != i:
            root[i] = i = root.get(up, up)
        return i

    out = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        out[i] = x != y
        root[x] = y
    return out


def block_links(lists: DataFrame, vertices: DataFrame, docs: DataFrame, percent: int, k: int = 5) -> DataFrame:
    """(a, b, sure): links between different components that share a list.

    A pair is compared in the first list that it shares. Its collisions are counted over all coordinates, then its sets are
    compared. Of the links on whole sets (sure) a task gives a forest; links on sampled sets are still to be confirmed.
    """
    needed = matches_needed(percent)
    # A bit for each coordinate under which the member is in an open list.
    bits = lists.groupBy("v").agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftright(post, 32) as int))")).alias("bits"))
    member = bits.join(vertices.select("v", "n_shingles", "signature"), "v").join(sampled_sets(docs, lists, k), "v")
    dealt = tiles(lists).join(stored(member, "members"), "v").repartition("post", "x", "y").sortWithinPartitions("post", "x", "y", "side")
    names = ["a", "b", "sure"]

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("post", "side", "v", "c", "n_shingles", "level")}
        signs, bits = _signs(batch), batch.column("bits").to_numpy(zero_copy_only=False).view(U64)
        group = _runs(batch)
        two_sided = np.asarray(batch.column("x")) != np.asarray(batch.column("y"))
        n, c, side = column["n_shingles"], column["c"], column["side"]
        here = U64(1) << (column["post"] >> 32).astype(U64)
        sets: _Sets | None = None
        held: list[np.ndarray] = []
        out: list[np.ndarray] = [np.zeros((2, 0), np.int64)]

        def settle() -> None:
            nonlocal sets
            if held:
                x, y = np.concatenate(held, axis=1)
                held.clear()
                order = np.argsort(x, kind="stable")
                x, y = x[order], y[order]
                sets = sets or _Sets(batch.column("hashes").to_pylist(), column["level"], percent)
                ok = sets.linked(x, y)
                out.append(np.stack([x[ok], y[ok]]))

        size = np.diff(np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)))
        for step in range(1, int(size.max(initial=1))):
            x = np.flatnonzero(group[step:] == group[:-step])
            y = x + step
            ok = (c[x] != c[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (~two_sided[x] | (side[x] != side[y]))
            x, y = x[ok], y[ok]
            same = collisions(signs[x], signs[y])
            shared = same & bits[x] & bits[y]
            ok = (np.bitwise_count(same) >= needed) & ((shared & (~shared + U64(1))) == here[x])
            if ok.any():
                held.append(np.stack([x[ok], y[ok]]))
                if sum(p.shape[1] for p in held) > 100_000:
                    settle()
        settle()
        x, y = np.concatenate(out, axis=1)
        whole = (column["level"][x] == 0) & (column["level"][y] == 0)
        keep = ~whole
        keep[whole] = _forest(x[whole], y[whole])
        a, b = column["v"][x[keep]], column["v"][y[keep]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(whole[keep])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([b for b in (held, batch) if b is not None]).combine_chunks()
            if not table.num_rows:
                continue
            batch = table.to_batches()[0]
            group = _runs(batch)
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield compare(batch.slice(0, cut))
            held = batch.slice(cut)
        if held is not None and held.num_rows:
            yield compare(held)

    return dealt.mapInArrow(run, "a long, b long, sure boolean")


def _runs(batch: pa.RecordBatch) -> np.ndarray:
    """Number of the (post, x, y) run that holds each row."""
    new = np.zeros(batch.num_rows, bool)
    for c in ("post", "x", "y"):
        values = np.asarray(batch.column(c))
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def likely(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` without most rows whose doc_id is not in ``wanted``; a join must follow, whose shuffle it makes smaller."""
    return bit_marked(docs, "doc_id", wanted, "doc_id", "__maybe").where("__maybe").drop("__maybe")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, k: int = 5) -> DataFrame:
    """Pairs whose full shingle sets have 100 * intersection >= percent * union."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = _texts(docs, wanted)

    def make(part: pa.RecordBatch) -> list:
        (x, at_x), (y, at_y) = (shingle_sets(part.column(c), k) for c in ("ta", "tb"))
        pair = np.concatenate([owner(at_x), owner(at_y)])
        both = pair[later(in_group(np.concatenate([x, y]), pair))]
        common = np.bincount(both, minlength=part.num_rows)
        keep = pa.array(100 * common >= percent * (np.diff(at_x) + np.diff(at_y) - common))
        return [part.column(c).filter(keep) for c in ("a", "b")]

    # The two sides' texts are cut by the bytes of both.
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                yield pa.RecordBatch.from_arrays(make(batch.slice(i, 64)), ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(v, c): the least vertex that can be reached, for every vertex with a link.

    Minimum labels spread over links and then jump to their label's label, so long chains shorten by half each round.
    Each round is a written table; tables that grow with the links are merged, not broadcast.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("c")), "labels")
    while True:
        named = lambda *names: labels.toDF(*names).hint("merge")  # noqa: B023, E731
        near = both.join(named("b", "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        spread = labels.join(near.hint("merge"), "v").select("v", F.least("c", "m").alias("c"))
        jump = spread.join(named("c", "up"), "c", "left").select("v", F.least("c", "up").alias("c"))
        new = stored(jump, "labels")
        changed = new.join(named("v", "old"), "v").where("c < old").limit(1).count()
        forget(labels)
        labels = new
        if not changed:
            forget(both)
            return labels


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (least doc_id reachable by links), kept (it is that document).

    Linked: 100 * intersection >= percent * union of the shingle sets. Null, empty and wordless texts have an empty set and
    link with nothing. Rows that repeat a doc_id are one document and get a row each; if their texts differ, the one with
    the greatest hash stands for it. Rows without doc_id link with nothing: they have no component and are kept. No rows
    give none; other columns are ignored.
    """
    seen = stored(features(docs, k), "features")
    row = F.max(F.struct("pick", "n_shingles", "set_a", "set_b", "signature"))
    each = stored(seen.where("doc_id is not null").groupBy("doc_id").agg(row.alias("r")).select("doc_id", "r.*").where("n_shingles > 0"), "each")
    vertices = stored(
        each.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("v"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "vertices"
    )
    prefix = stored(prefix_posts(vertices, percent), "prefix")
    links = stored(confirmed(stored(star_pairs(prefix, vertices, percent), "star"), docs, percent, k), "links-1")
    labels = components(links)
    more = stored(block_links(stored(open_lists(prefix, labels), "open"), vertices, docs, percent, k), "links-2")
    more = more.where("sure").select("a", "b").union(confirmed(more.where("not sure").select("a", "b").distinct(), docs, percent, k))
    more = stored(more, "links-3")
    if more.limit(1).count():
        labels = components(links.union(more))
    of_set = vertices.join(labels, "v", "left").select("set_a", "set_b", F.coalesce("c", "v").alias("c"))
    of_doc = each.select("doc_id", "set_a", "set_b").join(of_set, ["set_a", "set_b"]).select("doc_id", "c")
    return (
        seen.select("doc_id", "n_shingles")
        .join(of_doc, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )

"""A Merkle manifest of a dataset: one tree per group of rows, one over their roots, a proof for every row.

Leaves are ranked by a range partitioning, so no group is ever one task's. Superblocks of 8**DEPTH neighbouring nodes are reduced
to one node each, round after round, until every tree has one. On the way down the nodes of a round and the proofs of the
superblocks above them are cogrouped by superblock: there the local reduction is finished, the local and the outer part of each
proof are joined, and the claimed leaf is folded up to the root.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolake.llm.shared import forget, stored

#: Nodes of a run, and levels of a superblock.
WIDTH, DEPTH = 8, 4
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
_PATH = "array<struct<at: int, others: array<string>>>"
_NODES = "tree string, idx long, n long, digest string"


def field(value: Column) -> Column:
    """A value as the digest reads it: ``-`` for null, else its length in bytes, a colon, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def node(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def fold(leaf: str, path: list) -> str:
    """The root that ``leaf`` leads to: at each level it takes place ``at`` among the ``others`` of its run."""
    for step in path:
        others = list(step["others"])
        leaf = node([*others[: step["at"]], leaf, *others[step["at"] :]])
    return leaf


def reduction(digests: list[str], n: int, depth: int) -> list[list[str]]:
    """The levels of a superblock's reduction in a tree that has ``n`` nodes at its level: ``depth`` levels, fewer if one node
    remains before."""
    levels = [digests]
    while n > 1 and len(levels) <= depth:
        last = levels[-1]
        levels.append([node(last[i : i + WIDTH]) for i in range(0, len(last), WIDTH)])
        n = -(-n // WIDTH)
    return levels


def local_paths(levels: list[list[str]]) -> list[list[dict]]:
    """For each node of the first level, its place and the other nodes of its run, level by level."""
    out = [[] for _ in levels[0]]
    for depth, level in enumerate(levels[:-1]):
        steps = []
        for i in range(len(level)):
            first = i - i % WIDTH
            steps.append({"at": i - first, "others": level[first:i] + level[i + 1 : first + WIDTH]})
        for i, path in enumerate(out):
            path.append(steps[i // WIDTH**depth])
    return out


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, their place in their ``tree`` by ``order`` (nulls first), and ``n``, the tree's size.

    Rows are sorted over all partitions by range; each partition counts its part of each tree, and sums over these few counts
    say where it begins. Rows that tie in all of ``order`` are dealt at random.
    """
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order, "__tie")]
    spread = rows.withColumn("__tie", F.rand()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    placed = stored(spread.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), "ranked")
    counts = placed.groupBy("__part", tree).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(tree).orderBy("__part")
    sums = counts.withColumns({"__sum": F.sum("__n").over(before) - F.col("__n"), "n": F.sum("__n").over(Window.partitionBy(tree))})
    found = placed.join(sums.drop("__n"), ["__part", tree]).withColumn("idx", F.col("__sum") + F.col("__at") - F.col("__first"))
    found = stored(found.drop("__part", "__at", "__first", "__sum"), "nodes")
    forget(placed)
    return found


def _block(depth: int) -> Column:
    return F.expr(f"idx div {WIDTH**depth}").alias("block")


def _raised(nodes: DataFrame, depth: int) -> DataFrame:
    """One node for each superblock."""

    def top(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        n = int(part["n"].iloc[0])
        return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "n": [-(-n // WIDTH**depth)], "digest": [reduction(part["digest"].tolist(), n, depth)[-1][0]]})

    return nodes.select("tree", "idx", "n", "digest").groupBy("tree", _block(depth)).applyInPandas(top, _NODES)


def rise(nodes: DataFrame, depth: int, least: int = 0) -> list[DataFrame]:
    """``nodes`` (tree, idx, n, digest and others) and the nodes of every round above (``least`` rounds at least), the last with
    one node per tree."""
    rounds = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1 or len(rounds) <= least:
        rounds.append(stored(_raised(rounds[-1], depth), "merkle"))
        most = -(-most // WIDTH**depth)
    return rounds


def descend(nodes: DataFrame, above: DataFrame, depth: int, extra: list[str] | None = None) -> DataFrame:
    """``nodes`` with the proofs of the superblocks ``above`` them (tree, idx, subroot, root, path) joined to their own.

    With ``extra`` columns, which hold a claimed digest among them, nodes are leaves: they come with the root that the claim
    folds to."""
    leaves = extra is not None
    own = nodes.select("tree", "idx", "n", "digest", *(extra or []))
    kinds = dict(own.dtypes)
    schema = f"tree string, idx long, digest string, subroot string, root string, path {_PATH}"
    if leaves:
        schema += ", folded_root string" + "".join(f", {c} {kinds[c]}" for c in extra)

    def join(part: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        at = outer.iloc[0]
        rest = [{"at": int(s["at"]), "others": list(s["others"])} for s in at["path"]]
        paths = [p + rest for p in local_paths(reduction(part["digest"].tolist(), int(part["n"].iloc[0]), depth))]
        out = part[["tree", "idx", "digest", *(extra or [])]].assign(subroot=at["subroot"], root=at["root"])
        out["path"] = paths
        if leaves:
            out["folded_root"] = [fold(c, p) for c, p in zip(part["claim"], paths, strict=True)]
        return out

    over = above.select("tree", "idx", "subroot", "root", "path")
    # Superblocks of ``nodes`` are nodes above.
    return own.groupBy("tree", _block(depth)).cogroup(over.groupBy("tree", F.col("idx").alias("block"))).applyInPandas(join, schema)


def manifest(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Per row of ``leaves`` (doc_id, lang, leaf, claim): doc_id, lang, leaf, subroot, root, path, folded_root, verified.

    Each lang (null is one too) has a tree over its leaves by doc_id, nulls first, then by leaf; a tree over their roots by lang,
    null first, gives the root. ``path`` is the proof: at each level the place of the node in its run, and the run's other nodes.
    ``folded_root`` is what ``claim`` leads to along it, ``verified`` whether that is the root. ``depth`` levels of a tree are one superblock's. No rows give none.
    """
    rows = leaves.select(field(F.col("lang")).alias("tree"), "lang", "doc_id", F.col("leaf").alias("digest"), "claim")
    own = ranked(rows, "tree", ["doc_id", "digest"])  # trees need only be apart here, so the order of their names serves
    rounds = rise(own, depth, least=1)
    langs = own.groupBy("tree").agg(F.first("lang").alias("lang"))
    roots = rounds[-1].select("tree", "digest").join(langs, "tree").select(F.lit("").alias("all"), "lang", F.col("tree").alias("of"), "digest")
    tops = ranked(roots, "all", ["lang"]).withColumnRenamed("all", "tree")
    over = rise(tops, depth)
    down = over[-1].select("tree", "idx", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast(_PATH).alias("path"))
    for nodes in reversed(over[:-1]):
        down = descend(nodes, down, depth)
    down = down.select("tree", "idx", "root", "path").join(tops.select("tree", "idx", "of", "digest"), ["tree", "idx"])
    down = stored(down.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("idx"), F.col("digest").alias("subroot"), "root", "path"), "outer")
    for nodes in reversed(rounds[1:-1]):
        down = stored(descend(nodes, down, depth), "outer")
    out = descend(own, down, depth, ["claim", "doc_id", "lang"])
    return out.select("doc_id", "lang", F.col("digest").alias("leaf"), "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """Per row of ``docs``: doc_id, lang, leaf (the digest of its five columns), and claim, the same after A-Z of the text were
    lower-cased where ``tampered``. Nulls have their own mark, so no null equals a value; other columns are ignored."""
    columns = [F.col(c) for c in COLUMNS]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = digest(columns)
    return docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(tampered, digest([*columns[:-1], lower])).otherwise(leaf).alias("claim"))

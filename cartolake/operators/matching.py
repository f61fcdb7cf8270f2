"""Which texts contain which needles, without comparing all of them and without moving texts that no needle may be in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.functions.bitmaps import possible
from cartolake.sources.scratch import stored

GRAM = 3


def text_id(text: Column) -> Column:
    """Sixteen bytes that stand for a text."""
    return F.unhex(F.md5(text))


def _grams(size: int) -> Column:
    """(gram, at) of every ``size`` neighbouring characters of the column ``chars``, of which there are ``n``; grams are hashes."""
    part = lambda i: F.struct(F.xxhash64(F.lit(size), *[F.get("chars", i + j) for j in range(size)]).alias("gram"), i.alias("at"))
    made = F.transform(F.sequence(F.lit(0), F.col("n") - size), part)
    return F.when(F.col("n") >= size, made).otherwise(F.array().cast("array<struct<gram: bigint, at: int>>"))


def _exploded(rows: DataFrame, text: str, keep: list[str], grams: Column) -> DataFrame:
    rows = rows.select(*keep, F.split(text, "").alias("chars")).select(*keep, "chars", F.size("chars").alias("n"))
    # The outer form keeps the optimizer from testing for empty arrays, character by character, on the arrays' own expressions.
    return rows.select(*keep, F.explode_outer(grams).alias("g")).where("g is not null").select(*keep, "g.gram", "g.at")


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(workspace_id, needle, text_id) for each distinct needle within a distinct text of its tenant, as they are written.

    The grams of texts, of the lengths that needles have (three characters at most), are counted where they are. A needle (a
    shorter one by itself) is then looked up by its rarest gram alone: only that one is posted, with text id and place. Texts are met once, at the end, to compare the needle where it should begin; before that, those that surely
    have none are cleared by a bitmap where they are. Needles and places are written in between. Empty needles are in no text.
    """
    wanted = stored(needles.select("workspace_id", "needle").where("needle <> ''").distinct(), "needles")
    own = F.when(F.length("needle") >= GRAM, _grams(GRAM)).when(F.length("needle") == 2, _grams(2)).otherwise(_grams(1))
    asked = _exploded(wanted, "needle", ["workspace_id", "needle"], own)
    sizes = [r[0] for r in wanted.select(F.least(F.length("needle"), F.lit(GRAM))).distinct().collect()]  # three at most
    every = F.concat(*[_grams(size) for size in sorted(sizes) or [GRAM]])
    known = texts.where("text <> ''").select("workspace_id", text_id(F.col("text")).alias("text_id"), "text")
    grams = _exploded(known, "text", ["workspace_id", "text_id"], every)
    key = [F.col("workspace_id"), F.col("gram")]
    counts = grams.groupBy("workspace_id", "gram").agg(F.count(F.lit(1)).alias("times"))
    # A gram that no text has leaves the needle without a place.
    rated = asked.join(counts, ["workspace_id", "gram"], "left").fillna(0, ["times"])
    rarest = rated.groupBy("workspace_id", "needle").agg(F.min(F.struct("times", "gram", "at")).alias("c")).select("workspace_id", "needle", "c.gram", F.col("c.at").alias("from"))
    rarest = stored(rarest, "rarest")
    posts = possible(grams, key, rarest, key)
    places = rarest.join(posts, ["workspace_id", "gram"]).select("workspace_id", "needle", "text_id", (F.col("at") - F.col("from")).alias("start"))
    places = stored(places.where("start >= 0").distinct(), "places")
    spot = [F.col("workspace_id"), F.col("text_id")]
    held = possible(known, spot, places, spot).groupBy("workspace_id", "text_id").agg(F.first("text").alias("text"))  # copies are one
    same = F.substring("text", F.col("start") + 1, F.length("needle")) == F.col("needle")
    return places.join(held, ["workspace_id", "text_id"]).where(same).select("workspace_id", "needle", "text_id").distinct()


def contains_pairs(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(workspace_id, needle, text): the same with the texts themselves."""
    own = texts.select("workspace_id", "text").distinct().withColumn("text_id", text_id(F.col("text")))
    return containing(needles, texts).join(own, ["workspace_id", "text_id"]).select("workspace_id", "needle", "text")

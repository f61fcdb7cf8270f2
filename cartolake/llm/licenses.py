"""License scans by diagonal voting.

All rolling word k-grams of all texts are joined, by hash, to the places of the same k-grams in templates. A hit of place p on
template place t votes for the diagonal p - t. Votes are aggregated by diagonal; a phrase stands where one diagonal has all of
its k-grams. For longer templates neighbouring diagonals, between which words were put in or left out, are merged, and the merged
span is verified: its k-grams equal the template's word by word, and together they must cover most of the template.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolake.llm.shared import stored, text_or_empty

#: Phrases and their labels (fixed values); every place of one counts.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public notices by label; any of a label's texts will do.
NOTICES: dict[str, list[str]] = {
    "apache-notice": [
        "licensed under the Apache License, Version 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    ],
    "bsd-notice": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution."""
    ],
    "cc-by": ["licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "gpl-notice": [
        "licensed under the GNU General Public License, version 3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    ],
    "isc-notice": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies."""
    ],
    "mit-notice": [
        "released under the MIT License",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software.""",
    ],
    "mpl-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
PHRASE_GRAM, NOTICE_GRAM = 2, 3
#: Words that may be put in or left out between two parts of a span.
DRIFT = 4
#: Share of a notice's words that its span must hold.
COVER = 0.75
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def template_grams(phrases: dict[str, str], notices: dict[str, list[str]]) -> list[tuple]:
    """(template, label, length, k, place, gram) of every k-gram of every template. Phrases need two words at least, notices
    three."""
    templates = [(label, words_of(t), PHRASE_GRAM) for t, label in phrases.items()]
    templates += [(label, words_of(t), NOTICE_GRAM) for label, texts in notices.items() for t in texts]
    if any(len(w) < k for _, w, k in templates):
        raise ValueError("a template is too short")
    return [(i, label, len(w), k, p, w[p : p + k]) for i, (label, w, k) in enumerate(templates) for p in range(len(w) - k + 1)]


def gram_hash(words: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(words)), *[F.xxhash64(w) for w in words])


def table(spark: SparkSession, phrases: dict[str, str], notices: dict[str, list[str]]) -> DataFrame:
    """The templates' k-grams with their hashes, and a mark (template -1) that every text meets once."""
    rows = [(*r[:5], [*r[5], ""][:NOTICE_GRAM]) for r in template_grams(phrases, notices)] + [(-1, "", 0, 0, 0, [""] * NOTICE_GRAM)]
    grams = spark.createDataFrame(rows, "template int, label string, length int, k int, place int, gram array<string>")
    parts = [F.col("gram")[i] for i in range(NOTICE_GRAM)]
    made = F.when(F.col("k") == PHRASE_GRAM, gram_hash(parts[:PHRASE_GRAM])).when(F.col("k") == NOTICE_GRAM, gram_hash(parts)).otherwise(F.lit(0).cast("long"))
    return grams.withColumn("hash", made).coalesce(1)


def _rolling(k: int) -> Column:
    """Hashes of all neighbouring ``k`` words, from the words' hashes ``hashes``."""
    made = F.transform(F.sequence(F.lit(0), F.col("n") - k), lambda i: F.xxhash64(F.lit(k), *[F.get("hashes", i + j) for j in range(k)]))
    return F.when(F.col("n") >= k, made).otherwise(F.array().cast("array<bigint>"))


def hits(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, template, label, length, k, place, at): every k-gram of every text that is one of a template, word by
    word, and one mark for each row. ``row`` numbers the rows of ``docs``; it is fixed once the result is written."""
    text = text_or_empty()
    # lower() changes A-Z only where all characters are ASCII.
    lower = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    words = F.filter(F.split(lower, BETWEEN), lambda w: w != "")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("words"))
    rows = rows.select("row", "doc_id", "words", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    rows = rows.select("row", "doc_id", "words", "n", F.concat(F.array(F.lit(0).cast("long")), _rolling(PHRASE_GRAM), _rolling(NOTICE_GRAM)).alias("grams"))
    # No array is empty; the outer form keeps the optimizer from testing that, word by word, on the arrays' own expressions.
    flat = rows.select("row", "doc_id", "words", "n", F.posexplode_outer("grams").alias("p", "hash"))
    found = flat.join(F.broadcast(templates), "hash")  # as many rows as the templates have words
    before = F.when(F.col("k") == NOTICE_GRAM, F.greatest(F.col("n") - PHRASE_GRAM + 1, F.lit(0))).otherwise(0)
    found = found.withColumn("at", F.col("p") - 1 - before)
    same = (F.col("k") == 0) & (F.col("p") == 0) | (F.col("k") > 0) & (F.col("p") > 0)
    equal = F.when(F.col("k") == 0, True).otherwise(F.slice("words", F.greatest("at", F.lit(0)) + 1, F.greatest("k", F.lit(1))) == F.slice("gram", F.lit(1), F.greatest("k", F.lit(1))))
    return found.where(same & equal).select("row", "doc_id", F.col("n").cast("long").alias("n_words"), "template", "label", "length", "k", "place", "at")


def places(found: DataFrame) -> DataFrame:
    """(row, label, start) of every place where a phrase stands: its diagonal has a vote of each of its k-grams."""
    votes = found.where(F.col("k") == PHRASE_GRAM).groupBy("row", "template", "label", "length", (F.col("at") - F.col("place")).alias("start"))
    return votes.agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") == F.col("length") - PHRASE_GRAM + 1).select("row", "label", "start")


def spans(found: DataFrame) -> DataFrame:
    """(row, label, start, end, cover): merged diagonals of notices, the words that they span, and the share of the notice that
    they hold."""
    diagonal = (F.col("at") - F.col("place")).alias("diagonal")
    votes = found.where(F.col("k") == NOTICE_GRAM).groupBy("row", "template", "label", "length", diagonal)
    # As many places as the template has, at most.
    votes = votes.agg(F.min("at").alias("start"), (F.max("at") + NOTICE_GRAM).alias("end"), F.collect_set("place").alias("places"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT, F.lit(False)).cast("int")
    merged = votes.withColumn("apart", apart).withColumn("chain", F.sum("apart").over(along))
    held = merged.select("row", "template", "label", "length", "chain", "start", "end", F.explode("places").alias("place"))
    held = held.select("*", F.explode(F.sequence("place", F.col("place") + NOTICE_GRAM - 1)).alias("word"))
    held = held.groupBy("row", "template", "label", "length", "chain", "word").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    whole = held.groupBy("row", "template", "label", "length", "chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("covered"))
    return whole.select("row", "label", "start", "end", (F.col("covered") / F.col("length")).alias("cover"))


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, list[str]] | None = None, cover: float = COVER) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, places, spans, labels, score.

    ``places`` are all places of phrases (start, label), ``spans`` the verified ones of notices (start, end, label, cover), both
    sorted and empty where there are none; ``labels`` holds the sorted labels of both. ``score`` is 1 with a place, else the
    greatest share of a notice that the text holds. A-Z are lower-cased; words are stretches of ASCII letters, digits and all
    other characters above ASCII. Null counts as empty; repeated rows each get a row; no rows give none; other columns of
    ``docs`` are ignored.
    """
    spark = docs.sparkSession
    found = stored(hits(docs, table(spark, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)), "license-hits")
    own = found.where(F.col("k") == 0).select("row", "doc_id", "n_words")
    stand = places(found).groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), "label"))).alias("places"))
    span = F.when(F.col("cover") >= cover, F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label", "cover"))
    held = spans(found).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"), F.max("cover").alias("best"))
    out = own.join(stand, "row", "left").join(held, "row", "left")
    out = out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("places", "spans")})
    labels = F.array_sort(F.array_distinct(F.concat(F.col("places.label"), F.col("spans.label"))))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "places", "spans", labels.alias("labels"), score.alias("score"))

"""Quality rules as weak supervision: rules vote or abstain, and a posterior probability decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.llm.em import fit_votes
from cartolake.llm.kernel import Joined, in_group, later, owner, repeated, windows
from cartolake.llm.shared import mapped, slices, stored

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stops", "n_letters"]
#: Bytes that end a sentence.
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;"]] = True
#: Bytes that begin a letter or digit: ASCII ones, and the lead bytes of all other characters.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0xC2, 0xF5)]] = True


def measure(texts: pa.Array) -> list[np.ndarray]:
    """The columns of MEASURES for each text; null has no words."""
    joined = Joined(texts)
    data, at = joined.data, joined.at
    start, end, first = joined.words()
    n_words = np.diff(first)
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    inside = np.cumsum(inside)[:-1].astype(bool)
    word_chars = joined.per_text(inside & ((data & 0xC0) != 0x80))
    n_symbols = joined.per_text(_SYMBOL[data])
    n_stops = joined.per_text(_STOP[data])
    n_letters = joined.per_text(_LETTER[data])

    full = at[:-1][np.diff(at) > 0]
    begins = np.unique(np.concatenate([full, np.flatnonzero(data == 10) + 1]))
    begins = begins[begins < len(data)]
    doc = np.searchsorted(at, begins, side="right") - 1
    ends = np.append(begins[1:], len(data))
    ends = np.where(data[ends - 1] == 10, ends - 1, ends) if len(begins) else ends[:0]
    words_before = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    worded = words_before[ends] > words_before[begins]
    begins, ends, doc = begins[worded], ends[worded], doc[worded]
    n_lines = np.bincount(doc, minlength=joined.n)
    again = later(in_group(joined.hashes(begins, ends), doc))
    n_dup_lines = np.bincount(doc[again], minlength=joined.n)

    triples, place = windows(joined.hashes(start, end), first, 3)
    twice = place[repeated(in_group(triples, owner(first)[place]))] if len(place) else place
    covered = np.zeros(len(start), bool)
    for i in range(3):
        covered[twice + i] = True
    sums = np.concatenate([[0], np.cumsum(covered)])
    n_repeat = sums[first[1:]] - sums[first[:-1]]
    return [np.asarray(x, np.int64) for x in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat, n_lines, n_stops, n_letters)]


def measures(docs: DataFrame) -> DataFrame:
    """doc_id with the columns of MEASURES, over whole texts."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in MEASURES)
    return mapped(docs.select("doc_id", "text"), "text", schema, ["doc_id", *MEASURES], lambda part: [part.column("doc_id"), *measure(part.column("text"))])


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(good: F.Column, bad: F.Column) -> F.Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, F.Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains. Ratios are written as products, so nothing divides by zero."""
    c = F.col
    return {
        "length": _vote(c("n_words") >= 80, c("n_words") < 50),
        "word_size": _vote((c("word_chars") >= 3 * c("n_words")) & (c("word_chars") <= 9 * c("n_words")), (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 14 * c("n_words"))),
        "symbols": _vote(100 * c("n_symbols") <= 2 * c("n_words"), 100 * c("n_symbols") >= 20 * c("n_words")),
        "letters": _vote(100 * c("n_letters") >= 90 * c("word_chars"), 100 * c("n_letters") < 86 * c("word_chars")),
        "same_lines": _vote((c("n_lines") >= 2) & (c("n_dup_lines") == 0), (c("n_lines") >= 4) & (2 * c("n_dup_lines") >= c("n_lines"))),
        "repeats": _vote(100 * c("n_repeat_words") <= 10 * c("n_words"), 100 * c("n_repeat_words") >= 30 * c("n_words")),
        "sentences": _vote((40 * c("n_stops") >= c("n_words")) & (2 * c("n_stops") <= c("n_words")), (150 * c("n_stops") < c("n_words")) | (c("n_stops") > c("n_words"))),
    }


def _pattern() -> F.Column:
    return F.concat_ws(",", *[v.cast("string") for v in rules().values()])


def posteriors(found: DataFrame) -> DataFrame:
    """(pattern, quality): the posterior of each pattern of votes in ``found`` (measures), at most 3 to the number of rules.

    Votes of all rows are counted by pattern (at most three to the number of rules, so the driver's share is bounded), and
    expectation-maximisation runs on those counts.
    """
    seen = found.where(~base_failed()).groupBy(_pattern().alias("pattern")).count().collect()
    votes = np.array([[int(x) for x in r["pattern"].split(",")] for r in seen], dtype=int).reshape(-1, len(rules()))
    fitted = fit_votes(votes, np.array([r["count"] for r in seen], dtype=float))
    rows = [(r["pattern"], float(p)) for r, p in zip(seen, fitted["posterior"], strict=True)]
    return found.sparkSession.createDataFrame(rows, "pattern string, quality double").coalesce(1)


def judged(rows: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """``rows`` (with the columns of MEASURES) with base_failed, quality (0 where the base fails) and kept."""
    out = rows.withColumn("pattern", _pattern()).join(F.broadcast(table), "pattern", "left")  # a row per pattern
    out = out.withColumns({"base_failed": base_failed(), "quality": F.when(base_failed(), 0.0).otherwise(F.coalesce("quality", F.lit(0.0)))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop("pattern")


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row of ``docs``: doc_id, the columns of MEASURES, base_failed, quality (posterior), kept.

    kept is false where base_failed, else whether the posterior reaches ``threshold``. Null and empty texts have no words
    and fail the base; repeated rows each get a row; no rows give none; other columns of ``docs`` are ignored.
    """
    found = stored(measures(docs), "measures")
    return judged(found, posteriors(found), threshold)


def accepted(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with their columns.

    The measures are taken again beside each row, which costs less than bringing verdicts to the texts by a shuffle.
    """
    table = posteriors(stored(measures(docs), "measures"))

    def run(texts: pa.Array) -> pa.Array:
        parts = [measure(x.column("text")) for x in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text")]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(MEASURES)
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=MEASURES)

    # Only texts go to Python, and only numbers come back; taken once, as it is declared not to be repeatable.
    measured = F.arrow_udf(run, "struct<" + ", ".join(f"{c}: long" for c in MEASURES) + ">").asNondeterministic()
    own = docs.select(F.struct(*docs.columns).alias("doc"), measured("text").alias("m")).select("doc", "m.*")
    return judged(own, table, threshold).where("kept").select("doc.*")

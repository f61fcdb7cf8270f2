"""A quality classifier without hand labels: heuristic labellers, their accuracies by expectation-maximisation, and a hashed
linear scorer trained on the posterior labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.llm.em import fit_votes
from cartolake.llm.grams import SIZE, add_style, features, in_rows, scale_of
from cartolake.llm.quality_rules import measures, rules
from cartolake.llm.shared import mapped, stored, text_or_empty

#: Texts that the scorer is trained on at most.
TRAINING_ROWS = 2000


def labellers() -> dict[str, Column]:
    """Votes of overlapping labellers: the quality rules, and coarser or combined views of the same measures."""
    c = F.col
    vote = lambda good, bad: F.when(bad, -1).when(good, 1).otherwise(0)
    return rules() | {
        "clean": vote((c("n_symbols") == 0) & (c("n_dup_lines") == 0), 100 * c("n_symbols") >= 8 * c("word_chars")),
        "loops": vote(20 * c("n_repeat_words") <= c("n_words"), (2 * c("n_repeat_words") >= c("n_words")) & (c("n_words") > 20)),
        "empty": vote(c("n_words") >= 5, c("n_words") == 0),
    }


def label_model(found: DataFrame) -> DataFrame:
    """``found`` (measures) with ``weak_label``, the posterior that a text is good. Patterns of votes are counted over all
    rows; their number is bounded by the labellers, so the driver holds no more."""
    pattern = F.concat_ws(",", *[v.cast("string") for v in labellers().values()])
    seen = found.groupBy(pattern.alias("pattern")).count().collect()
    votes = np.array([[int(x) for x in r["pattern"].split(",")] for r in seen], dtype=int).reshape(-1, len(labellers()))
    posterior = fit_votes(votes, np.array([r["count"] for r in seen], dtype=float))["posterior"]
    if not seen:
        return found.withColumn("weak_label", F.lit(None).cast("double"))
    known = found.sparkSession.createDataFrame([(r["pattern"], float(p)) for r, p in zip(seen, posterior, strict=True)], "pattern string, weak_label double")
    return found.withColumn("pattern", pattern).join(F.broadcast(known), "pattern").drop("pattern")  # a row per pattern


def logistic(x: np.ndarray, p: np.ndarray, strength: float = 1e-3, rounds: int = 300) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic scorer on soft labels."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    step = 4 / (float((x * x).sum()) / max(1, len(x)) + strength)
    w = v = np.zeros(x.shape[1], np.float32)
    t = 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30))) - p
        new = v - step * (strength * v + x.T @ error.astype(np.float32) / max(1, len(x)))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v = new + (last - 1) / t * (new - w)
        w = new
    return w.astype(np.float32)


def _features(texts: pa.Array) -> np.ndarray:
    return add_style(features(texts), texts)


def fit_scorer(docs: DataFrame, labelled: DataFrame, rows: int = TRAINING_ROWS) -> dict:
    """A scorer from at most ``rows`` texts: of those that are rather good and those that are rather bad, the ones with the
    least hashes of doc_id, half of ``rows`` each. A doc_id counts once, with its least text; rows without one, and ids whose
    rows have different labels, are not trained on."""
    ids = labelled.where("doc_id is not null").groupBy("doc_id").agg(F.min("weak_label").alias("weak_label"), F.max("weak_label").alias("__most"))
    ids = ids.where("weak_label = __most").select("doc_id", "weak_label")
    least = lambda side: ids.where(side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
    picked = least(F.col("weak_label") < 0.5).union(least(F.col("weak_label") >= 0.5))  # bounded by rows

    def make(part: pa.RecordBatch) -> list:
        raw = [r.astype(np.float16).tobytes() for piece in in_rows(part) for r in _features(piece.column("text"))]
        return [part.column("weak_label"), pa.array(raw, pa.binary())]

    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "weak_label").agg(F.min("text").alias("text")).select("weak_label", "text")  # repeated rows are one
    found = mapped(texts, "text", "weak_label double, x binary", ["weak_label", "x"], make).collect()
    if not found:
        return {"scale": np.ones(SIZE, np.float32), "weights": np.zeros(SIZE + 1, np.float32)}
    found.sort(key=lambda r: (r["weak_label"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in found]).astype(np.float32)
    scale = scale_of(x)
    return {"scale": scale, "weights": logistic(x * scale, np.array([r["weak_label"] for r in found], np.float32))}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score): the scorer's probability that each whole text is good; empty texts get 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: one weight per hashed feature

    def make(part: pa.RecordBatch) -> list:
        out = []
        for piece in in_rows(part):
            x = _features(piece.column("text"))
            line = (x * sent.value["scale"]) @ sent.value["weights"][:-1] + sent.value["weights"][-1]
            empty = np.asarray(pc.binary_length(piece.column("text"))) == 0
            out.append(np.where(~empty, 1 / (1 + np.exp(-np.clip(line, -30, 30))), 0.0))
        return [part.column("doc_id"), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())]

    return mapped(docs.select("doc_id", text_or_empty().alias("text")), "text", "doc_id long, score double", ["doc_id", "score"], make)


def classify_quality(docs: DataFrame, threshold: float = 0.5, rows: int = TRAINING_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, score (0 to 1), kept (score >= threshold).

    Labellers vote on all rows; the scorer is trained on at most ``rows`` of them and then reads every whole text. Null and
    empty texts score 0 and are not kept. Repeated rows each get a row; no rows give none; other columns are ignored.
    """
    labelled = label_model(stored(measures(docs), "measures"))
    return score(docs, fit_scorer(docs, labelled, rows)).withColumn("kept", F.col("score") >= threshold)

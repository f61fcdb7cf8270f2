"""Language identification in two steps: the language family, then one-versus-one linear support vector machines in it."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.llm.grams import features, in_rows, scale_of
from cartolake.llm.shared import mapped, text_or_empty

#: Texts that training gets at most, over all languages together.
TRAINING_ROWS = 2000
UNKNOWN = "und"
#: Languages of one family compete in its second step; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "indic": ["hi", "mr", "ne", "bn", "gu", "pa"],
    "turkic": ["tr", "az", "kk", "uz", "ky"],
    "uralic": ["fi", "et", "hu"],
    "semitic": ["ar", "he", "mt"],
}


def svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-3, rounds: int = 80) -> np.ndarray:
    """Weights (the last is the intercept) of a linear machine with squared hinge loss; ``y`` is 1 or -1, classes balanced."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 1 / (2 * largest(x, weight) + strength)
    w = v = np.zeros(x.shape[1], np.float32)
    t = 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (strength * v - 2 * (x.T @ (weight * y * slack)))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v = new + (last - 1) / t * (new - w)
        w = new
    return w.astype(np.float32)


def largest(x: np.ndarray, weight: np.ndarray, rounds: int = 12) -> float:
    """An upper estimate of the largest eigenvalue of x' diag(weight) x, by power iteration."""
    v = np.full(x.shape[1], 1 / np.sqrt(x.shape[1]), np.float32)
    size = 0.0
    for _ in range(rounds):
        v = x.T @ (weight * (x @ v))
        size = float(np.linalg.norm(v))
        if not size:
            return 0.0
        v /= size
    return 1.3 * size


def one_versus_one(x: np.ndarray, label: np.ndarray, classes: list[str]) -> dict:
    pairs = list(combinations(range(len(classes)), 2))
    weights = []
    for i, j in pairs:
        use = np.isin(label, [classes[i], classes[j]])
        weights.append(svm(x[use], np.where(label[use] == classes[i], 1.0, -1.0).astype(np.float32)))
    return {"classes": classes, "pairs": pairs, "weights": np.array(weights, np.float32).reshape(len(pairs), x.shape[1] + 1)}


def decide(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class number and a score in (0, 1): most duels won, then the largest sum of margins; the score is its weakest duel's."""
    n, k = len(x), len(model["classes"])
    wins, sums, weakest = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
    if model["pairs"]:
        margins = x @ model["weights"][:, :-1].T + model["weights"][:, -1]
        for m, (i, j) in zip(margins.T, model["pairs"], strict=True):
            for c, own in ((i, m), (j, -m)):
                wins[:, c] += own > 0
                sums[:, c] += own
                weakest[:, c] = np.minimum(weakest[:, c], own)
    best = np.lexsort((np.arange(k)[None, :].repeat(n, 0), -sums, -wins), axis=1)[:, 0]
    return best, 1 / (1 + np.exp(-np.clip(3 * weakest[np.arange(n), best], -30, 30)))


def train(x: np.ndarray, lang: np.ndarray, families: dict[str, list[str]]) -> dict:
    """A family model and a model for each family, from feature rows and their languages."""
    family_of = {code: name for name, codes in families.items() for code in codes}
    own = np.array([family_of.get(c, c) for c in lang])
    scale = scale_of(x)
    x = x * scale
    names = sorted(set(own))
    return {
        "scale": scale,
        "family": one_versus_one(x, own, names),
        "members": [one_versus_one(x[own == f], lang[own == f], sorted(set(lang[own == f]))) for f in names],
    }


def predict(model: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    x = x * model["scale"]
    family, sure = decide(model["family"], x)
    lang, score = np.empty(len(x), object), np.zeros(len(x))
    for f, member in enumerate(model["members"]):
        at = np.flatnonzero(family == f)
        if len(at):
            best, own = decide(member, x[at])
            lang[at] = [member["classes"][c] for c in best]
            score[at] = sure[at] * own
    return lang.tolist(), score


def training_rows(docs: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """(lang, text): at most ``rows`` texts with a language in all, about an equal share per language, chosen by hash.

    Each language has a threshold on hashes of doc_id, from its count; so ids are picked where they are, and no language is
    gathered. A doc_id counts once, with its least language and text of that; rows without one are left out. More than
    ``rows`` languages are an error.
    """
    usable = docs.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang", "text", F.xxhash64("text").alias("__h"))
    ids = usable.groupBy("doc_id").agg(F.min(F.struct("lang", "__h")).alias("one")).select("doc_id", "one.*")  # no texts
    counts = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = counts.limit(rows + 1).count()
    if langs > rows:
        raise ValueError("more languages than training rows")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    placed = ids.join(F.broadcast(counts), "lang").withColumn("__at", place * F.col("n") * langs / rows).where("__at < 1")  # at most ``rows`` counts
    picked = placed.orderBy("__at", "doc_id").limit(rows).select("doc_id", "lang", "__h")
    texts = usable.join(F.broadcast(picked), ["doc_id", "lang", "__h"])
    return texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")  # repeated rows are one


def fit(docs: DataFrame, families: dict[str, list[str]] | None = None, rows: int = TRAINING_ROWS) -> dict | None:
    """A model from the labelled rows of ``docs``; None if there are none."""

    def make(part: pa.RecordBatch) -> list:
        lang, raw = [], []
        for piece in in_rows(part):
            lang += piece.column("lang").to_pylist()
            raw += [r.astype(np.float16).tobytes() for r in features(piece.column("text"))]
        return [pa.array(lang, pa.string()), pa.array(raw, pa.binary())]

    found = mapped(training_rows(docs, rows), "text", "lang string, x binary", ["lang", "x"], make).collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in found]).astype(np.float32)
    return train(x, np.array([r["lang"] for r in found], object), families or FAMILIES)


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score (0 to 1).

    Whole texts are read. Null texts and texts without any letter are ``und`` with score 0, and so is all without a model.
    Repeated rows each get a row; no rows give none; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: weights of the models, whatever the number of rows

    def make(part: pa.RecordBatch) -> list:
        lang, score = [], []
        for piece in in_rows(part):
            texts = piece.column("text").to_pylist()
            letters = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            if sent.value is None:
                lang += [UNKNOWN] * len(texts)
                score += [0.0] * len(texts)
                continue
            own, sure = predict(sent.value, features(piece.column("text")))
            lang += [x if ok else UNKNOWN for x, ok in zip(own, letters, strict=True)]
            score += np.where(letters, sure, 0.0).tolist()
        return [part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())]

    names = ["doc_id", "lang_pred", "score"]
    return mapped(docs.select("doc_id", text_or_empty().alias("text")), "text", "doc_id long, lang_pred string, score double", names, make)

"""A training-corpus pipeline: quality rules, exact and near deduplication, surrogates for personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its output is written as Parquet and read
again. All but the last return the columns of ``documents``. Extra columns go along, whatever their names; nulls in lang, source
and n_chars do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.llm.exact_dedup import exact_dedup, locator
from cartolake.llm.minhash import near_duplicates
from cartolake.llm.packing import pack_documents
from cartolake.llm.pii import replace_entities
from cartolake.llm.quality_rules import accepted
from cartolake.llm.queries import surrogate_key
from cartolake.llm.shared import bit_marked, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept. Null and empty texts have no words, so they go; each of several equal rows is judged
    alike."""
    return accepted(docs)


def _without(rows: DataFrame, column: str, dropped: DataFrame, key: str) -> DataFrame:
    """``rows`` but for those whose ``column`` is a ``key`` of ``dropped``. Only rows that a bitmap of fixed size cannot clear
    are shuffled to be met with the keys."""
    marked = bit_marked(rows, column, dropped, key, "__maybe")
    hit = F.col(column) == F.col("__key")
    held = marked.where("__maybe").join(dropped.select(F.col(key).alias("__key")), hit, "left_anti")
    return marked.where("not __maybe").unionByName(held).drop("__maybe")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for the case of A-Z: the one with the largest doc_id, of rows that share
    it the last by place. Null counts as empty; a row without doc_id stays only where the whole group has none."""
    dropped = stored(exact_dedup(docs, with_row=True).where("not kept").select("row"), "dropped")
    rows = docs.select(F.struct(*docs.columns).alias("__doc"), locator().alias("__row"))
    return _without(rows, "__row", dropped, "row").select("__doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest doc_id. Those without doc_id, without words
    or with a null text stay, and so do all rows that share a doc_id that stays."""
    dropped = stored(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "dropped")
    rows = docs.select(F.struct(*docs.columns).alias("__doc"), F.col("doc_id").alias("__id"))
    return _without(rows, "__id", dropped, "doc_id").select("__doc.*")


def mask_entities(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates in place of personal data; n_chars follows the new text, and both stay null where the text is null. Equal texts
    get equal surrogates."""
    made = replace_entities(docs, surrogate_key(spark), count="__entities").drop("__entities")
    return made.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed token sequences. A null or empty text is the end mark alone; each of several equal rows is packed."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii_surrogates", mask_entities),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

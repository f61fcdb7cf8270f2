"""The corpus pipeline, each stage on its own input against plain versions of what it must keep."""

import collections
import os
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cartolake.llm.quality_rules import quality_rules
from tests.llm.test_operators import LOWER, near_plain, plain_measures

SF = "/root/testdata/sf0.001"
CLASHING = ["__doc", "__row", "__id", "__maybe", "row", "kept", "v", "n_entities", "own", "__x", "value", "bits", "doc", "quality", "pattern", "batch"]


def run_stage(spark, number, docs, path):
    name, stage = corpus_pipeline.STAGES[number]
    docs.write.parquet(f"{path}/{name}-in")
    source = spark.read.schema(docs.schema).parquet(f"{path}/{name}-in")
    out = stage(spark, source, SF)
    out.write.parquet(f"{path}/{name}-out")
    return spark.read.schema(out.schema).parquet(f"{path}/{name}-out")


def plain_copies(rows):
    best = {}
    for i, text in rows:
        key = (text or "").translate(LOWER)
        best[key] = max(best.get(key, -1), i)
    return sorted(best.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in CLASHING})
    seen = [docs]
    for number in range(len(corpus_pipeline.STAGES)):
        seen.append(run_stage(spark, number, seen[-1], tmp_path))
    rows = [{r.doc_id: r for r in d.collect()} for d in seen[:-1]]
    for d, own in zip(seen[1:-1], rows[1:], strict=True):
        assert d.columns == docs.columns
        assert all(getattr(r, c) == f"{c}-{i}" for i, r in own.items() for c in CLASHING if not c.startswith("__"))
    # 1: what the rules keep, and never a text that fails the base
    kept = {r.doc_id for r in quality_rules(seen[0]).where("kept").collect()}
    assert set(rows[1]) == kept and all((m := plain_measures(rows[0][i].text))[0] >= 50 and 2 * m[4] <= m[0] for i in kept)
    # 3: one row of each group of equal texts
    assert sorted(rows[2]) == plain_copies([(i, r.text) for i, r in rows[1].items()])
    # 5: one row of each component
    label = near_plain([(i, r.text) for i, r in rows[2].items()])
    assert sorted(rows[3]) == sorted(i for i, (_, c) in label.items() if i == c)
    # 2: every row stays, and texts differ only where there are entities
    assert set(rows[4]) == set(rows[3]) and all(r.n_chars == len(r.text) for r in rows[4].values())
    changed = [i for i, r in rows[4].items() if r.text != rows[3][i].text]
    assert 0 < len(changed) < len(rows[4]) / 2 and not any("@mail" in r.text for r in rows[4].values())
    # 8: all ids of all texts, each in one piece
    library, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), collections.defaultdict(list)
    for p in seen[5].collect():
        at[p.doc_id].append(p)
    assert set(at) == set(rows[4])
    for i, pieces in at.items():
        ids, place = [*library.encode(rows[4][i].text, add_special_tokens=False).ids, 1], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == place and p.ids_crc32 == zlib.crc32(np.array(ids[place : place + p.length], "<u4").tobytes())
            place += p.length
        assert place == len(ids)


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows."""
    good = " ".join(f"word{i} and, more." for i in range(60))
    rows = [(1, good, "en", "s", 1), (1, good, "en", "s", 1), (2, good.upper(), None, None, None), (None, good + " tail", "en", "s", 2), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "lone " * 60000, "en", "s", 9), (6, " ".join(f"t{i}." for i in range(40000)), "en", "s", 9), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ids = lambda d: sorted((r.doc_id is None, r.doc_id or 0) for r in d.select("doc_id").collect())
    some = docs.where("text is not null")
    assert ids(run_stage(spark, 0, docs, tmp_path / "a")) == sorted((r.doc_id is None, r.doc_id or 0) for r in quality_rules(docs).where("kept").collect())
    assert ids(run_stage(spark, 1, docs, tmp_path / "b")) == [(False, 2), (False, 4), (False, 5), (False, 6), (True, 0)]
    near = run_stage(spark, 2, docs, tmp_path / "c")
    assert ids(near) == [(False, 1), (False, 1), (False, 3), (False, 4), (False, 5), (False, 6), (True, 0), (True, 0)]
    assert run_stage(spark, 3, docs, tmp_path / "d").count() == len(rows)
    assert run_stage(spark, 4, some, tmp_path / "e").agg(F.sum("length")).first()[0] > 40000


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for number in range(len(corpus_pipeline.STAGES)):
        assert run_stage(spark, number, docs, tmp_path).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0

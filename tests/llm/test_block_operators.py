"""Periodic runs, license scans and the Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolake.llm import licenses, merkle, periodic_runs, queries
from tests.llm.test_operators import DOC, EDGES, LOWER, WORD, corpus

CLASHING = "row doc words n hash hashes grams p at k place label length template idx tree digest claim block path root runs start period collapsed h g a".split()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(i):
    return zlib.crc32(str(i).encode())


def odd(spark, tmp_path):
    """Nulls in any column, rows without doc_id, repeated rows, ties, empty and very long texts, clashing columns."""
    long = "All work. " * 30000
    texts = [(None, "mit license " * 20), (None, None), (1, "a b " * 40), (1, "a b " * 40), (2, "A b " * 40), (4, None), (4, ""), (5, long), (6, "x"), (7, "汉" * 3000), (-8, "\x00 \t\n"), (9, "MIT License; the Apache\nlicense")]
    rows = [(i, t, [None, "en", "de", "fr"][n % 4], [None, "s"][n % 2], [None, n][n % 2]) for n, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, DOC).withColumns({c: F.lit("own") for c in CLASHING}).repartition(3).write.parquet(str(tmp_path / "docs"))
    return rows, spark.read.parquet(str(tmp_path / "docs"))


def table(spark, path, rows):
    path.mkdir()
    spark.createDataFrame(rows, DOC).repartition(2).write.parquet(str(path / "documents.parquet"))
    return str(path)


# --- 11: periodic runs ----------------------------------------------------------------------------------------------
def plain_runs(x):
    """Every period in rising order; a stretch that a smaller period has is not taken again."""
    out = {}
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i + q < len(x):
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i - s + q >= max(24, 3 * q):
                out.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


def made_words(r):
    v, n = r.choice([1, 2, 3, 5, 50, 1000]), r.choice([0, 1, 5, 23, 24, 25, 48, 60, 100, 300, 700])
    x = [f"w{r.randrange(v)}" for _ in range(n)]
    for _ in range(r.randint(0, 4)):
        if n >= 24:
            a = r.randrange(n)
            p = r.randint(1, max(1, (n - a) // 3))
            for i in range(a, min(n, a + p * r.randint(2, 9))):
                x[i] = x[a + (i - a) % p]
    return x


def found_runs(texts):
    _, ids, at = periodic_runs.numbered([" ".join(x).encode() for x in texts])
    out = [[] for _ in texts]
    for t, *run in zip(*[c.tolist() for c in periodic_runs.find_runs(ids, at)], strict=True):
        out[t].append(tuple(run))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed):
    r = random.Random(seed)
    texts = [made_words(r) for _ in range(60)]
    assert found_runs(texts) == [plain_runs(x) for x in texts]


def test_runs_where_hashes_lie(monkeypatch):
    """Where equal hashes of unequal words let a stretch reach too far, its text is walked word by word."""
    r, reach = random.Random(11), periodic_runs.reach
    texts = [made_words(r) for _ in range(60)]
    monkeypatch.setattr(periodic_runs, "reach", lambda sums, a, d, most, back: np.minimum(reach(sums, a, d, most, back) + a % 3, most))
    assert found_runs(texts) == [plain_runs(x) for x in texts]


def test_long_periods(monkeypatch):
    """Periods of more than the longest block, in many short steps and in chunks of blocks."""
    monkeypatch.setattr(periodic_runs, "TOP", 16)
    monkeypatch.setattr(periodic_runs, "CELLS", 64)
    r = random.Random(5)
    texts = [made_words(r) for _ in range(60)]
    assert found_runs(texts) == [plain_runs(x) for x in texts]


def test_transform_is_exact():
    r = np.random.default_rng(1)
    for n in (16, 128, 256, 4096, 1 << 15):
        x = r.integers(0, periodic_runs.P, (2, n // 2))
        got = periodic_runs.ntt(periodic_runs.reduced(x.astype(float)), n).astype(np.int64) % periodic_runs.P
        step = pow(periodic_runs.ROOT, (periodic_runs.P - 1) // n, periodic_runs.P)
        for k in (0, 1, n // 2 + 1, n - 1):
            want = [sum(int(v) * pow(step, j * k, periodic_runs.P) for j, v in enumerate(row)) % periodic_runs.P for row in x]
            assert got[:, k].tolist() == want


def test_digits_keep_sums_below_the_prime():
    for most in (1, 2, 900, 70_000, 1_000_000):
        for block in (8, 64, 4096, periodic_runs.TOP):
            d = periodic_runs.digits(np.array([0, most - 1, most // 2]), block)
            assert len(d) * block * (d.max() - d.min()) ** 2 < periodic_runs.P and len({tuple(c) for c in d.T}) == len({0, most - 1, most // 2})


def spliced(i, text):
    w, h = WORD.findall(text or ""), crc(i)
    n, g = len(w), h // 10
    if i is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
    return w


def plain_11(i, text):
    w = spliced(i, text)
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, sha(lines), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_op11(spark, tmp_path):
    r = random.Random(7)
    texts = [(i, " \t".join(made_words(r))) for i in range(300)] + [(1000 + i, t) for i, t in EDGES]
    got = {x.doc_id: tuple(x)[1:] for x in queries.op11_periodic_runs(spark, table(spark, tmp_path / "sf", [(i, t, "en", "s", 0) for i, t in texts])).collect()}
    assert got == {i: plain_11(i, t) for i, t in texts}


def test_runs_of_odd_rows(spark, tmp_path):
    rows, docs = odd(spark, tmp_path)
    got = periodic_runs.periodic_runs(docs).collect()
    want = [(i, [*plain_runs(WORD.findall(t or ""))] if len(t or "") < 10_000 else [(0, 60_000, 2)], t) for i, t, *_ in rows]
    assert sorted((str(x.doc_id), [tuple(y) for y in x.runs]) for x in got) == sorted((str(i), runs) for i, runs, _ in want)
    assert {x.collapsed for x in got if x.doc_id == 5} == {"All work."} and {x.collapsed for x in got if x.doc_id == 4} == {""}
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


# --- 12: license scans ----------------------------------------------------------------------------------------------
def plain_12(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(p, label) for t, label in licenses.PHRASES.items() for p in range(len(w)) if w[p : p + len(t.split())] == t.split()]
    labels, best = {label for _, label in places}, 0.0
    for label, texts in licenses.NOTICES.items():
        for t in map(licenses.words_of, texts):
            hits = sorted((a - p, p) for p in range(len(t) - 2) for a in range(len(w) - 2) if w[a : a + 3] == t[p : p + 3])
            chains = []
            for d, p in hits:
                if not chains or d - chains[-1][0] > licenses.DRIFT:
                    chains.append([d, set()])
                chains[-1][0] = d
                chains[-1][1] |= {p, p + 1, p + 2}
            for _, held in chains:
                best = max(best, len(held) / len(t))
                labels |= {label} if len(held) / len(t) >= licenses.COVER else set()
    at = [p for p, _ in places]
    names = ",".join(sorted({label for _, label in places}))
    return (len(w), len(places), min(at, default=None), max(at, default=None), names, ",".join(sorted(labels)), 1.0 if places else best)


def license_texts():
    r = random.Random(3)
    out, filler = [], [f"f{i}" for i in range(40)] + ["the", "of", "license", "software"]
    notices = [t for texts in licenses.NOTICES.values() for t in texts]
    for i in range(120):
        w = [r.choice(filler) for _ in range(r.randint(0, 60))]
        if i % 3:
            own = re.split(r"\s+", r.choice(notices))
            for _ in range(r.choice([0, 0, 1, 2, 8])):
                x = r.randrange(len(own))
                own[x : x + r.randint(0, 1)] = r.choice([[], ["odd"], ["odd", "words", "here"], ["two", "by"] * 4])
            w[len(w) // 2 : len(w) // 2] = own * r.choice([1, 1, 2])
        w += r.choice([[], [], ["MIT-License"], ["mit", "licenses"], ["General", "Public", "License."], ["apache", "license"] * 3])
        out.append(" ".join(w).upper() if i % 7 == 0 else " ".join(w))
    return [*out, "é mit license É", "mitlicense mit_license", "permission is hereby granted"]


def test_op12(spark, tmp_path):
    texts = list(enumerate(license_texts())) + [(1000 + i, t) for i, t in EDGES]
    got = {x.doc_id: tuple(x)[1:] for x in queries.op12_license_scan(spark, table(spark, tmp_path / "sf", [(i, t, "en", "s", 0) for i, t in texts])).collect()}
    assert got == {i: plain_12(t) for i, t in texts}
    assert len({labels for *_, labels, _ in got.values()}) > 8


def test_licenses_of_odd_rows(spark, tmp_path):
    rows, docs = odd(spark, tmp_path)
    out = licenses.scan_licenses(docs)
    assert {"row", "template", "k"}.isdisjoint(out.columns)
    got = out.collect()
    assert sorted((str(x.doc_id), x.n_words, len(x.places), x.score) for x in got) == sorted((str(i), *(p := plain_12(t))[:2], p[-1]) for i, t, *_ in rows)
    assert [[p.label for p in x.places] for x in got if x.doc_id == 9] == [["mit", "apache"]]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    assert {x.score for x in licenses.scan_licenses(docs, {}, {}).collect()} == {0.0}
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs, {"one": "x"}, {})


def test_verified_spans(spark):
    notice = licenses.NOTICES["isc-notice"][0]
    text = "before it " + notice.replace("with or without fee", "for free, with or without any fee") + " after it"
    (span,) = licenses.scan_licenses(corpus(spark, [(1, text)])).first().spans
    words = licenses.words_of(text)
    assert span.label == "isc-notice" and words[span.start] == "permission" and words[span.end - 1] == "copies" and span.cover >= 0.8


# --- 13: Merkle manifest --------------------------------------------------------------------------------------------
def plain_tree(leaves):
    """Levels of a tree."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_13(rows):
    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    trees = {}
    for i, text, lang, source, n in rows:
        changed = text.translate(LOWER) if text is not None and i is not None and crc(i) % 3 == 0 else text
        trees.setdefault(lang, []).append((i is not None, i or 0, leaf((i, source, lang, n, text)), leaf((i, source, lang, n, changed)), i))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {lang: plain_tree([x[2] for x in sorted(trees[lang])]) for lang in order}
    top = plain_tree([built[lang][-1][0] for lang in order])
    out = []
    for t, lang in enumerate(order):
        for k, (_, _, own, claim, i) in enumerate(sorted(trees[lang])):
            proof, cur = [], claim
            for place, levels in ((k, built[lang]), (t, top)):
                for level in levels[:-1]:
                    run, at = level[place - place % 8 : place - place % 8 + 8], place % 8
                    proof += run[:at] + run[at + 1 :]
                    cur = sha("".join(run[:at] + [cur] + run[at + 1 :]))
                    place //= 8
            out.append((i, own, built[lang][-1][0], top[-1][0], sha("".join(proof)), cur, cur == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(n, langs):
    r = random.Random(n)
    return [(i, r.choice([None, "", "Text É ß", f"lower {i}", f"UPPER {i}"]), langs[min(int(r.expovariate(1)), len(langs) - 1)], r.choice([None, "s"]), r.choice([None, i])) for i in r.sample(range(10 * n), n)]


@pytest.mark.parametrize("n, langs, depth", [(1, ["en"], 4), (9, [None, "en"], 4), (700, ["en", None, "é", "z", "a", "b", "c", "d", "e", "f"], 1), (700, ["en", "de"], 2), (5000, ["en", "de", "fr"], 4)])
def test_manifest(spark, n, langs, depth):
    rows = manifest_rows(n, langs)
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    out = merkle.manifest(merkle.leaves(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0), depth).collect()
    got = sorted(((x.doc_id, x.leaf, x.subroot, x.root, sha("".join(y for s in x.path for y in s.others)), x.folded_root, x.verified) for x in out), key=str)
    assert got == plain_13(rows)
    assert all(merkle.fold(x.leaf, x.path) == x.root for x in out[:50])


def test_op13(spark, tmp_path):
    rows = manifest_rows(400, ["en", None, "de"])
    out = queries.op13_merkle_manifest(spark, table(spark, tmp_path / "sf", rows))
    assert sorted((tuple(x) for x in out.collect()), key=str) == plain_13(rows)
    assert {x.verified for x in out.collect()} == {True, False}


def test_manifest_of_odd_rows(spark, tmp_path):
    rows, docs = odd(spark, tmp_path)
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    out = merkle.manifest(merkle.leaves(docs, third)).collect()
    assert sorted(((x.doc_id, x.leaf, x.root) for x in out), key=str) == sorted(((x[0], x[1], x[3]) for x in plain_13(rows)), key=str)
    assert merkle.manifest(merkle.leaves(docs.limit(0), third)).count() == 0

"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.llm.bpe import bpe_digests
from cartolake.llm.exact_dedup import exact_dedup
from cartolake.llm.langid import fit, identify
from cartolake.llm.licenses import BETWEEN, COVER, DRIFT, NOTICE_GRAM, NOTICES, PHRASE_GRAM, PHRASES, scan_licenses, words_of
from cartolake.llm.merkle import leaves, manifest
from cartolake.llm.minhash import near_duplicates
from cartolake.llm.packing import pack_documents
from cartolake.llm.periodic_runs import LEAST, REPEATS, periodic_runs
from cartolake.llm.pii import replace_entities
from cartolake.llm.quality_classifier import classify_quality
from cartolake.llm.quality_rules import quality_rules
from cartolake.llm.rindex import remove_repeats
from cartolake.llm.token_counts import token_counts


def surrogate_key(spark: SparkSession) -> str:
    """The secret that surrogates depend on, from the session; the test tables do with a public one."""
    return spark.conf.get("spark.cartolake.surrogateKey", "key of the test tables")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(documents(spark, sf_dir), surrogate_key(spark)).select("doc_id", "text", "n_entities")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op6_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    out = identify(docs, fit(docs.where(third != 1)))
    return out.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def spliced(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``; every tenth text by hash of doc_id is made periodic from some word on. Without doc_id or
    words a text stays as it is."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", hashed.alias("h"), F.when(hashed % 10 == 0, words).alias("words"))
    rows = rows.select("*", F.size("words").alias("n"), F.floor(F.col("h") / 10).alias("g"))
    rows = rows.select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int").alias("a"))
    rows = rows.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    left = F.col("n") - F.col("a")
    cycles = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(cycles, F.lit(1), left)), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(spliced(documents(spark, sf_dir)))
    # Runs come by start, then period; a later one must be greater.
    greater = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.reduce("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda b, r: F.when(greater(b, r), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(documents(spark, sf_dir))
    base = F.array_join(F.array_sort(F.array_distinct("places.label")), ",")
    first, last = F.array_min("places.start"), F.array_max("places.start")
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), first.alias("first_word"), last.alias("last_word"),
        base.alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    out = manifest(leaves(documents(spark, sf_dir), third))
    siblings = F.array_join(F.flatten(F.col("path.others")), "")
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_run_length_index": op6_run_length_index,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_pack_sequences": op8_pack_sequences,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_license_scan": op12_license_scan,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: Lower-casing A-Z only, as DuckDB's lower() also changes other letters.
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of doc_id as decimal text: a byte is mixed in, then come its eight shifts (-1).
_CRC32 = """xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
    lambda i: [ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END))"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _templates() -> str:
    """Rows (template, label, k, words) of phrases and notices."""
    rows = [(PHRASE_GRAM, label, t) for t, label in PHRASES.items()] + [(NOTICE_GRAM, label, t) for label, texts in NOTICES.items() for t in texts]
    return ", ".join(f"({i}, '{label}', {k}, [{', '.join(repr(w) for w in words_of(t))}])" for i, (k, label, t) in enumerate(rows))


ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_ASCII_LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op5_minhash_near_dedup": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
        g AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN []
                WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
                ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
        r AS (
            SELECT doc_id AS d, doc_id AS c FROM documents
            UNION SELECT r.d, z.b FROM r JOIN (SELECT x AS a, y AS b FROM e UNION ALL SELECT y, x FROM e) z ON z.a = r.c)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id, w.doc_id = min(r.c) AS kept
        FROM w JOIN r ON r.d = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id, n.n""",
    "op11_periodic_runs": f"""
        WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {_CRC32} AS h FROM documents),
        a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM c),
        p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
        d AS (
            SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
                THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
        g AS (SELECT doc_id, n, i, md5_number(array_to_string(w[i + 1:i + 8], ' ')) AS gram FROM (SELECT *, unnest(range(0, n - 7)) AS i FROM d)),
        e AS (
            SELECT x.doc_id, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
            FROM g x JOIN g y ON y.doc_id = x.doc_id AND y.gram = x.gram AND y.i > x.i AND {REPEATS} * (y.i - x.i) <= x.n),
        s AS (SELECT doc_id, q, min(i) AS start, count(*) + 7 + q AS length FROM e GROUP BY doc_id, q, island),
        r AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest({LEAST}, {REPEATS} * q) GROUP BY doc_id, start, length),
        b AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
                first(struct_pack(start := start, length := length, period := period) ORDER BY length / period DESC, start, period) AS best FROM r GROUP BY doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words
            FROM (SELECT doc_id, unnest(range(0, n)) AS i, unnest(w) AS word FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
            1000 * best.length // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
        FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op12_license_scan": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        t(template, label, k, words) AS (VALUES {_templates()}),
        tg AS (SELECT template, label, k, len(words) AS length, p AS place, array_to_string(words[p + 1:p + k], ' ') AS gram FROM (SELECT *, unnest(range(0, len(words) - k + 1)) AS p FROM t)),
        g AS (
            SELECT doc_id, {PHRASE_GRAM} AS k, p AS pos, array_to_string(w[p + 1:p + {PHRASE_GRAM}], ' ') AS gram FROM (SELECT *, unnest(range(0, len(w) - {PHRASE_GRAM - 1})) AS p FROM d)
            UNION ALL SELECT doc_id, {NOTICE_GRAM}, p, array_to_string(w[p + 1:p + {NOTICE_GRAM}], ' ') FROM (SELECT *, unnest(range(0, len(w) - {NOTICE_GRAM - 1})) AS p FROM d)),
        h AS (SELECT g.doc_id, tg.*, pos, pos - place AS diagonal FROM g JOIN tg ON tg.k = g.k AND tg.gram = g.gram),
        places AS (SELECT doc_id, label, diagonal AS start FROM h WHERE k = {PHRASE_GRAM} GROUP BY doc_id, template, label, length, diagonal HAVING count(*) = length - {PHRASE_GRAM - 1}),
        base AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
        v AS (SELECT DISTINCT doc_id, template, label, length, diagonal FROM h WHERE k = {NOTICE_GRAM}),
        l AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o > {DRIFT} THEN 1 ELSE 0 END AS apart FROM v WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
        c AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS chain FROM l),
        held AS (
            SELECT DISTINCT c.doc_id, c.template, c.label, c.length, chain, unnest(range(place, place + {NOTICE_GRAM})) AS word
            FROM c JOIN h ON h.doc_id = c.doc_id AND h.template = c.template AND h.diagonal = c.diagonal),
        whole AS (SELECT doc_id, label, count(*) / length AS cover FROM held GROUP BY doc_id, template, label, length, chain),
        named AS (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM whole WHERE cover >= {COVER}),
        n AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM named GROUP BY doc_id),
        m AS (SELECT doc_id, max(cover) AS cover FROM whole GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
            coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(cover, 0.0::DOUBLE) END AS score
        FROM d LEFT JOIN base USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE c AS (
            SELECT doc_id, lang, {_field('lang')} AS tree, sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars')} || {_field('text')}) AS leaf,
                sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars')} || {_field(f"CASE WHEN text IS NOT NULL THEN {_ASCII_LOWER} END")}) AS other, {_CRC32} % 3 = 0 AS tampered
            FROM documents),
        d AS (
            SELECT doc_id, lang, tree, leaf, CASE WHEN tampered THEN other ELSE leaf END AS claim,
                row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM c),
        t AS (
            SELECT tree, 0 AS lvl, i, n, leaf AS h FROM d
            UNION ALL SELECT tree, lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY tree, lvl, i // 8, n),
        s AS (
            SELECT tree, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
            FROM (SELECT tree, h FROM t WHERE n = 1) JOIN (SELECT DISTINCT tree, lang FROM d) USING (tree)),
        u AS (
            SELECT 100 AS lvl, i, n, subroot AS h FROM s
            UNION ALL SELECT lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 8, n),
        nodes AS (SELECT tree, lvl, i, n, h FROM t UNION ALL SELECT '', lvl, i, n, h FROM u),
        sides AS (
            SELECT a.tree, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lo, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS hi
            FROM nodes a LEFT JOIN nodes b ON b.tree = a.tree AND b.lvl = a.lvl AND b.i // 8 = a.i // 8 AND b.i <> a.i WHERE a.n > 1 GROUP BY a.tree, a.lvl, a.i),
        steps AS (
            SELECT d.doc_id, x.lvl, x.lo, x.hi FROM d JOIN sides x ON x.tree = d.tree AND x.i = d.i // (8 ** x.lvl)::BIGINT
            UNION ALL SELECT d.doc_id, x.lvl, x.lo, x.hi FROM d JOIN s ON s.tree = d.tree JOIN sides x ON x.tree = '' AND x.i = s.i // (8 ** (x.lvl - 100))::BIGINT),
        paths AS (SELECT doc_id, string_agg(lo || hi, '' ORDER BY lvl) AS proof, list(lo || '|' || hi ORDER BY lvl) AS sides FROM steps GROUP BY doc_id),
        f AS (
            SELECT d.doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
                list_reduce(list_concat([claim], coalesce(paths.sides, [])), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
            FROM d JOIN s ON s.tree = d.tree LEFT JOIN paths ON paths.doc_id = d.doc_id)
        SELECT *, folded_root = root AS verified FROM f""",
}

"""Registered queries of the corpus, extraction, correlation, question, context, report, change and streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.functions import exprs as X
from cartolake.operators import changes, context, corpus, correlate, extract, graph_read, manifests, project, questions, reports
from cartolake.plans import adapters as A
from cartolake.plans import manifest_queries  # noqa: F401
from cartolake.plans.queries import C_ID, GRAPH, ORACLE_SQL, Q_ID, QUERIES, S_ID, V_ID, W_FACTS, W_GRAPH, csv, guid_sql, query
from cartolake.schemas import EDGES, NODES
from cartolake.sources import readers, writers
from cartolake.streaming import streams

NOW = "TIMESTAMP '1998-08-02 00:00:00'"
EVENTS_NOW = "(SELECT max(ts) FROM events)"


def now() -> F.Column:
    return F.lit("1998-08-02 00:00:00").cast("timestamp")


def files(spark, sf_dir) -> DataFrame:
    """The corpus with paths that the filters know."""
    f = A.load(spark, sf_dir, FILES)
    return f.withColumn("content", F.col("text").cast("binary"))


FILES = """
SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'src/Vendor/' WHEN 1 THEN 'a/.hid/' WHEN 2 THEN '.env/' ELSE 'lib/' END || source || '/d' || CAST(doc_id AS STRING) ||
       CASE doc_id % 8 WHEN 0 THEN '.PNG' WHEN 1 THEN '.g.cs' WHEN 2 THEN '_pb2.py' WHEN 3 THEN '.py' WHEN 4 THEN '.ts' WHEN 5 THEN '.go' ELSE '.cs' END AS path,
       'ws' || CAST(doc_id % 4 AS STRING) AS workspace_id, source AS repo_id, n_chars AS length,
       CASE doc_id % 7 WHEN 0 THEN '// Code generated by x' || chr(10) || text WHEN 1 THEN '   ' WHEN 2 THEN 'a' || chr(0) || text ELSE text END AS text FROM documents"""
_F = f"WITH d AS ({FILES}) SELECT doc_id FROM d WHERE "


def _filter(name: str, f, where: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(files(spark, sf_dir)).select("doc_id")
    ORACLE_SQL[name] = _F + where


_filter("f1_drop_ignored_dirs", corpus.drop_ignored_dirs, "doc_id % 9 <> 0")
_filter("f2_drop_dot_segments", corpus.drop_dot_segments, "doc_id % 9 <> 1")
_filter("f3_drop_binary_ext", corpus.drop_binary_ext, "doc_id % 8 <> 0")
_filter("f4_drop_generated_names", corpus.drop_generated_names, "doc_id % 8 NOT IN (1, 2)")
_filter("f5_drop_oversize", lambda d: corpus.drop_oversize(d, 2000), "length <= 2000")
_filter("f6_drop_binary_content", corpus.drop_binary_content, "doc_id % 7 <> 2")
_filter("f7_drop_autogenerated", corpus.drop_autogenerated, "doc_id % 7 <> 0")
_filter("f10_skip_blank", corpus.skip_blank, "doc_id % 7 <> 1")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def f8_content_hash(spark, sf_dir):
    return corpus.content_hash(A.load(spark, sf_dir, "SELECT doc_id, text FROM documents")).select("doc_id", "content_hash")


@query(f"WITH d AS ({FILES}) SELECT repo_id, count(*) AS considered, count(*) FILTER (WHERE doc_id % 9 > 1 AND doc_id % 8 > 2 AND length <= 1048576) AS kept FROM d GROUP BY ALL")
def f9_scan_counters(spark, sf_dir):
    return corpus.scan_counters(files(spark, sf_dir))


@query(f"WITH d AS ({FILES}) SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'unknown' WHEN 2 THEN 'python' WHEN 3 THEN 'python' WHEN 4 THEN 'typescript' WHEN 5 THEN 'go' ELSE 'csharp' END AS language FROM d")
def f11_detect_language(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", corpus.detect_language(F.col("path")).alias("language"))


_SRC = "'a http://x // c' || chr(10) || text || chr(9) || ' ' || chr(10) || chr(10) || chr(10) || chr(10) || '/* ' || text || ' */z # q'"


@query(f"""WITH d AS (SELECT doc_id, {_SRC} AS t FROM documents) SELECT doc_id, regexp_replace(regexp_replace(CASE doc_id % 2 WHEN 0 THEN regexp_replace(replace(replace(regexp_replace(t, '/\\*(.|\\n)*?\\*/', '', 'g'), ' // c', ' '), 'unused', ''), 'zzz', '', 'g')
    ELSE regexp_replace(t, '#[^\\n\\r]*', '', 'g') END, '[ \\t]+(\\n|$)', '\\1', 'g'), '(\\r?\\n){{3,}}', chr(10) || chr(10), 'g') AS trimmed FROM d""")
def f12_trim_source(spark, sf_dir):
    t = A.load(spark, sf_dir, f"SELECT doc_id, {_SRC} AS t FROM documents")
    return t.select("doc_id", corpus.trim_source(F.col("t"), F.when(F.col("doc_id") % 2 == 0, "csharp").otherwise("python")).alias("trimmed"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def f13_estimate_tokens(spark, sf_dir):
    return A.load(spark, sf_dir, "SELECT doc_id, text FROM documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT page_id FROM pages WHERE page_id % 3 <> 0")
def f14_reject_path_traversal(spark, sf_dir):
    p = A.load(spark, sf_dir, "SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/a/../' ELSE '/a..b/' END || url AS path FROM pages")
    return p.where(~X.has_traversal(F.col("path"))).select("page_id")


@query("SELECT page_id, 'a/b' || replace(url, '\\', '/') AS path FROM pages")
def f15_normalise_path(spark, sf_dir):
    return A.load(spark, sf_dir, "SELECT page_id, url FROM pages").select("page_id", X.normalise_path(F.concat(F.lit("/\\a\\b"), "url")).alias("path"))


_CUT = "split_part(split_part(trim(url), '?', 1), '#', 1)"


@query(f"SELECT page_id, regexp_replace('/' || regexp_replace(regexp_replace({_CUT}, '^.*?://', ''), '^[^/]*', ''), '/{{2,}}', '/', 'g') AS path FROM pages")
def f16_normalise_http_path(spark, sf_dir):
    return A.load(spark, sf_dir, "SELECT page_id, url FROM pages").select("page_id", X.normalise_http_path(F.col("url")).alias("path"))


_URLS = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'https://github.com/o' WHEN 1 THEN 'git@github.com:o' ELSE 'https://gitlab.com/o' END || CAST(p_size AS STRING) || '/' || replace(p_name, ' ', '-') || CASE p_partkey % 2 WHEN 0 THEN '.git' ELSE '' END AS url FROM part"


@query(f"SELECT p_partkey, 'o' || CAST(p_size AS VARCHAR) AS owner, replace(p_name, ' ', '-') AS name FROM part WHERE p_partkey % 3 <> 2")
def f17_parse_repo_url(spark, sf_dir):
    r = A.load(spark, sf_dir, _URLS).withColumn("r", X.parse_repo_url(F.col("url")))
    return r.where("r is not null").select("p_partkey", "r.owner", "r.name")


@query("SELECT p_partkey, replace(p_name, ' ', '-') AS name FROM part")
def f18_derive_repo_name(spark, sf_dir):
    return A.load(spark, sf_dir, _URLS).select("p_partkey", X.derive_repo_name(F.col("url")).alias("name"))


# --- extraction -----------------------------------------------------------------------------------------------------
_P = f"p(prompt_id) AS (VALUES {', '.join(f'({chr(39)}{p}{chr(39)})' for p in extract.PROMPTS)})"
_R = f"WITH {_P}, r AS (SELECT doc_id, source, lang, text, prompt_id, 'Find ' || prompt_id || ' in d' || doc_id || ':' || chr(10) || text AS prompt, sha256(text || '|' || prompt_id || '|v1|small') AS h FROM documents CROSS JOIN p)"


def _requests(spark, sf_dir) -> DataFrame:
    docs = A.load(spark, sf_dir, "SELECT doc_id, source, lang, text, 'd' || CAST(doc_id AS STRING) AS path FROM documents")
    r = extract.render_prompt(extract.fan_out_prompts(docs, extract.prompts(spark)))
    return r.withColumn("content_hash", extract.cache_key(F.col("text"), F.col("prompt_id"), F.col("version"), F.lit("small")))


def _cache(spark, sf_dir) -> DataFrame:
    """Results of every third document's requests."""
    r = _requests(spark, sf_dir).where("doc_id % 3 = 0")
    return r.select("content_hash", F.lit("ws0").alias("workspace_id"), F.lit("small").alias("model"), F.lit("v1").alias("prompt_version"), F.concat_ws(":", "prompt_id", F.length("text")).alias("result"), F.lit(1).alias("hit_count"), now().alias("created_at")).dropDuplicates(["content_hash"])


@query(_R + " SELECT doc_id, prompt_id FROM r")
def x1_fan_out_prompts(spark, sf_dir):
    return _requests(spark, sf_dir).select("doc_id", "prompt_id")


@query(_R + " SELECT doc_id, prompt_id, md5(prompt) AS prompt_md5 FROM r")
def x2_render_prompt(spark, sf_dir):
    return _requests(spark, sf_dir).select("doc_id", "prompt_id", F.md5("prompt").alias("prompt_md5"))


@query(_R + " SELECT doc_id, prompt_id, h AS content_hash FROM r")
def x3_cache_key(spark, sf_dir):
    return _requests(spark, sf_dir).select("doc_id", "prompt_id", "content_hash")


_HIT = ", c AS (SELECT DISTINCT h, prompt_id || ':' || length(text) AS result FROM r WHERE doc_id % 3 = 0)"


@query(_R + _HIT + " SELECT doc_id, r.prompt_id, result FROM r JOIN c USING (h)")
def x4_cache_hits(spark, sf_dir):
    return extract.cache_hits(_requests(spark, sf_dir), _cache(spark, sf_dir)).select("doc_id", "prompt_id", "result")


@query(_R + _HIT + " SELECT doc_id, prompt_id FROM r WHERE h NOT IN (SELECT h FROM c)")
def x5_cache_misses(spark, sf_dir):
    return extract.cache_misses(_requests(spark, sf_dir), _cache(spark, sf_dir)).select("doc_id", "prompt_id")


@query(_R + _HIT + " SELECT h AS content_hash, 1 + count(*) AS hit_count FROM r JOIN c USING (h) GROUP BY ALL")
def x6_bump_hit_count(spark, sf_dir):
    cache = _cache(spark, sf_dir)
    return extract.bump_hit_count(cache, extract.cache_hits(_requests(spark, sf_dir), cache)).select("content_hash", "hit_count")


@query(_R + _HIT + " SELECT h AS content_hash, result || '!' AS result, 1 AS hit_count FROM c")
def x7_upsert_cache(spark, sf_dir):
    cache = _cache(spark, sf_dir)
    new = cache.withColumns({"result": F.concat("result", F.lit("!")), "hit_count": F.lit(0)})
    return extract.upsert_cache(cache, new).select("content_hash", "result", "hit_count")


@query(f"""WITH q AS ({A.QUESTIONS}) SELECT workspace_id, 'f' || CAST(id % 50 AS VARCHAR) AS file_path, substr(sha256('Known answers:' || chr(10) || string_agg('- Q: ' || question || chr(10) || '  A: yes', chr(10) ORDER BY created_at DESC, id DESC)), 1, 12) AS hash12 FROM q WHERE status = 'Answered' GROUP BY ALL""")
def x8_ground_truth_block(spark, sf_dir):
    q = A.load(spark, sf_dir, A.QUESTIONS).where("status = 'Answered'")
    rows = q.select("workspace_id", F.concat(F.lit("f"), (F.col("id") % 50).cast("string")).alias("file_path"), F.col("created_at").alias("answered_at"), "id", "question", F.lit("yes").alias("answer"))
    return extract.ground_truth_block(rows).select("workspace_id", "file_path", "hash12")


@query(f"""WITH e AS ({A.GEDGES}), n AS ({A.GNODES}), x AS (SELECT DISTINCT n.source_file AS path, '- ' || s.name || ' ' || e.label || ' ' || n.name AS line FROM n JOIN e ON e.target_id = n.id JOIN n s ON s.id = e.source_id WHERE n.source_file IS NOT NULL),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS r FROM x) WHERE r <= 40)
    SELECT path, substr(sha256('Entities:' || chr(10) || nn || chr(10) || 'Edges:' || chr(10) || ee), 1, 12) AS hash12 FROM (SELECT path, string_agg(line, chr(10) ORDER BY line) AS ee FROM t GROUP BY path)
    JOIN (SELECT source_file AS path, string_agg(DISTINCT '- ' || label || ' ' || name, chr(10) ORDER BY '- ' || label || ' ' || name) AS nn FROM n GROUP BY ALL) USING (path)""")
def x9_structural_block(spark, sf_dir):
    n, e = A.load(spark, sf_dir, A.GNODES), A.load(spark, sf_dir, A.GEDGES)
    own = n.where("source_file is not null").select(F.col("source_file").alias("path"), "id", "label", "name")
    lines = own.select("path", F.col("id").alias("target_id"), F.col("name").alias("target_name")).join(e, "target_id").join(n.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")
    return extract.structural_block(own, lines.select("path", "source_name", "label", "target_name").distinct()).select("path", "hash12")


@query("SELECT doc_id, 'service:' || length(text) AS service, 'storage:' || length(text) AS storage FROM documents")
def x10_assemble_record(spark, sf_dir):
    r = _requests(spark, sf_dir).where("prompt_id <> 'conventions'")
    rows = r.select(F.lit("w").alias("workspace_id"), F.col("source").alias("repo_id"), F.col("doc_id").alias("path"), "prompt_id", F.concat_ws(":", "prompt_id", F.length("text")).alias("result"))
    return extract.assemble_record(rows).select(F.col("path").alias("doc_id"), "service", "storage")


@query(_R + " SELECT doc_id, prompt_id, CAST(length(prompt) AS VARCHAR) AS result FROM r")
def x11_extract_with(spark, sf_dir):
    """The caller's function here gives each prompt's length."""
    r = _requests(spark, sf_dir).select("doc_id", "prompt_id", "prompt")
    return extract.extract_with(r, lambda prompts: prompts.str.len().astype(str)).select("doc_id", "prompt_id", "result")


@query(f"""WITH f AS ({A.FACTS}) SELECT DISTINCT file_path AS path, m.method, m.route FROM f, LATERAL (VALUES (upper(method), '/api' || path), ('GET', '/x' || path), ('POST', '/x' || path)) m(method, route)""")
def x12_extract_routes(spark, sf_dir):
    f = A.load(spark, sf_dir, A.FACTS)
    text = F.concat(F.lit('[Route("api")]\nclass A {\n[Http'), F.initcap("method"), F.lit('("'), "path", F.lit('")]\n}\n@app.route("/x'), "path", F.lit('", methods=["GET", "post"])\n'))
    return extract.extract_routes(f.select(F.col("file_path").alias("path"), text.alias("text")))


@query(f"SELECT workspace_id, model, CAST(sum((cost_e8 + 50) // 100) AS BIGINT) AS cost_micro FROM ({A.COSTED}) GROUP BY ALL")
def x13_model_cost(spark, sf_dir):
    c = extract.model_cost(A.load(spark, sf_dir, A.CALLS))
    return c.groupBy("workspace_id", "model").agg((F.sum("cost_usd") * 1000000).cast("long").alias("cost_micro"))


@query(W_FACTS + "SELECT workspace_id, file_path FROM f WHERE contains(file_path, '/l1.')")
def x14_latest_for_files(spark, sf_dir):
    e = A.extractions(spark, sf_dir)
    return extract.latest_for_files(e, e.where(F.col("file_path").contains("/l1."))).select("workspace_id", "file_path")


@query(W_FACTS + "SELECT file_path FROM f WHERE event_name IN ('Brand#11', 'Brand#12') ORDER BY file_path LIMIT 15")
def x15_search_extractions(spark, sf_dir):
    return extract.search_extractions(A.extractions(spark, sf_dir), ["BRAND#11", "brand#12"], 15).select("file_path")


# --- correlation ----------------------------------------------------------------------------------------------------
def _first5(c: str) -> str:
    return f"array_to_string(list_sort(list(DISTINCT {c}))[1:5], ',')"


@query(W_FACTS + f"""SELECT workspace_id, repo_id, service_name AS service, count(*) AS file_count, {_first5('file_path')} AS files, array_to_string(list_sort(list(DISTINCT sha256('storage|' || storage_name || '|')))[1:10], ',') AS hashes FROM f GROUP BY ALL""")
def c1_summarize_services(spark, sf_dir):
    s = correlate.summarize_services(A.parsed(spark, sf_dir))
    return s.select("workspace_id", "repo_id", "service", "file_count", csv("files").alias("files"), csv("convention_hashes").alias("hashes"))


@query(W_FACTS + f"""SELECT workspace_id, repo_id, event_name AS event, string_agg(DISTINCT direction, ',' ORDER BY direction DESC) AS directions, {_first5('file_path')} AS files FROM f WHERE direction <> 'none' GROUP BY ALL""")
def c2_summarize_events(spark, sf_dir):
    return correlate.summarize_events(A.parsed(spark, sf_dir)).withColumns({"directions": csv("directions"), "files": csv("files")})


@query(W_FACTS + f"""SELECT workspace_id, repo_id, storage_name AS name, 'table' AS type, access, count(*) AS file_count, {_first5('file_path')} AS files FROM f GROUP BY ALL""")
def c3_summarize_storages(spark, sf_dir):
    return correlate.summarize_storages(A.parsed(spark, sf_dir)).withColumn("files", csv("files"))


@query(W_FACTS + """SELECT DISTINCT workspace_id, event_name, sha256('{"workspace_id":"' || workspace_id || '","event_name":"' || event_name || '"}') AS summary_hash FROM f""")
def c4_summary_hash(spark, sf_dir):
    return correlate.summary_hash(A.load(spark, sf_dir, A.FACTS).select("workspace_id", "event_name").distinct())


def _map(spark, sf_dir) -> DataFrame:
    return A.load(spark, sf_dir, A.FACTS).select("workspace_id", "repo_id", "file_path", F.col("service_name").alias("service"))


@query(W_FACTS + "SELECT workspace_id, repo_id, file_path, CASE WHEN contains(file_path, '/l1.') THEN 'Listed' ELSE min(service_name) END AS service FROM f GROUP BY workspace_id, repo_id, file_path")
def c5_file_service_map(spark, sf_dir):
    f = A.load(spark, sf_dir, A.FACTS)
    listed = f.where(F.col("file_path").contains("/l1.")).groupBy("workspace_id", "repo_id").agg(F.collect_set("file_path").alias("source_files"))
    listed = listed.select("workspace_id", "repo_id", F.lit(1).alias("ord"), F.lit("Listed").alias("name"), F.array(F.lit("other")).alias("aliases"), "source_files")
    return correlate.file_service_map(listed, A.parsed(spark, sf_dir))


@query(W_FACTS + "SELECT workspace_id, repo_id, file_path, CASE repo_id WHEN 'repo1' THEN 'M' ELSE service_name END AS service FROM f")
def c6_synthesise_service(spark, sf_dir):
    m = _map(spark, sf_dir).where("repo_id <> 'repo1'")
    manifests = A.load(spark, sf_dir, A.FACTS).select("workspace_id", "repo_id", F.lit("M").alias("name")).distinct()
    return correlate.synthesise_service(m, manifests, A.parsed(spark, sf_dir))


@query(W_FACTS + """, m AS (SELECT workspace_id, repo_id, file_path, min(service_name) AS service_name FROM f WHERE contains(file_path, '/l1.') GROUP BY ALL),
    d AS (SELECT workspace_id, repo_id, split_part(file_path, '/', 2) AS d, min(service_name) AS s FROM m GROUP BY ALL), a AS (SELECT workspace_id, repo_id, min(service_name) AS s FROM m GROUP BY ALL)
    SELECT f.workspace_id, f.repo_id, f.file_path, CASE WHEN m.service_name IS NOT NULL THEN m.service_name WHEN d.s IS NOT NULL THEN d.s ELSE a.s END AS service,
    CASE WHEN m.service_name IS NOT NULL THEN 1 WHEN d.s IS NOT NULL OR a.s IS NOT NULL THEN 3 ELSE 0 END AS tier FROM (SELECT DISTINCT workspace_id, repo_id, file_path FROM f) f
    LEFT JOIN m USING (workspace_id, repo_id, file_path) LEFT JOIN d ON d.workspace_id = f.workspace_id AND d.repo_id = f.repo_id AND d.d = split_part(f.file_path, '/', 2) LEFT JOIN a ON a.workspace_id = f.workspace_id AND a.repo_id = f.repo_id""")
def c7_resolve_owner(spark, sf_dir):
    m = _map(spark, sf_dir)
    return correlate.resolve_owner(m, m.where(F.col("file_path").contains("/l1.")))


_CAP = "CASE p_size % 4 WHEN 0 THEN 'XCommandHandler' WHEN 1 THEN 'JoinUseCase' WHEN 2 THEN 'Handler' ELSE 'FindQuery' END"


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'X' WHEN 1 THEN 'Join' ELSE 'Find' END AS name, CASE p_size % 4 WHEN 0 THEN 'command-handler' WHEN 1 THEN 'use-case' ELSE 'query' END AS kind FROM part WHERE p_size % 4 <> 2")
def c8_capability_from_path(spark, sf_dir):
    p = A.load(spark, sf_dir, f"SELECT p_partkey, 'a/b/' || {_CAP} || '.cs' AS path FROM part")
    return p.withColumn("c", correlate.capability_from_path(F.col("path"))).where("c is not null").select("p_partkey", "c.name", "c.kind")


@query(W_FACTS + """, x AS (SELECT unnest(['EXPOSES', 'CALLS', 'FOLLOWS', 'PUBLISHES', CASE access WHEN 'owns' THEN 'WRITES_TO' ELSE 'READS_FROM' END, CASE direction WHEN 'publish' THEN 'PUBLISHES' WHEN 'consume' THEN 'CONSUMES' END]) AS edge, repo_id FROM f)
    SELECT edge, count(*) FILTER (WHERE repo_id <> 'repo1') AS stitched, count(*) FILTER (WHERE repo_id = 'repo1') AS unmatched FROM x WHERE edge IS NOT NULL GROUP BY ALL""")
def c9_stitch_edges(spark, sf_dir):
    p = A.parsed(spark, sf_dir)
    nameless = p.withColumn("rec", F.col("rec").withField("service", F.lit(None).cast(p.schema["rec"].dataType["service"].dataType)))
    owners = _map(spark, sf_dir).distinct().withColumn("service", F.when(F.col("repo_id") != "repo1", F.col("service")))
    return correlate.stitch_counts(correlate.stitch_edges(nameless, owners))


@query(f"WITH e AS ({A.GEDGES}), n AS ({A.GNODES}) SELECT DISTINCT 'w' AS workspace_id, s.label || '1' AS source, t.label || '1' AS target FROM e JOIN n s ON s.id = e.source_id JOIN n t ON t.id = e.target_id")
def c10_service_depends_on(spark, sf_dir):
    n, e = A.load(spark, sf_dir, A.GNODES), A.load(spark, sf_dir, A.GEDGES)
    g = n.select(F.lit("r").alias("repo_id"), "id", F.concat(F.lit("/"), "id").alias("source_file"))
    m = n.select(F.lit("w").alias("workspace_id"), F.lit("r").alias("repo_id"), F.col("id").alias("file_path"), F.concat("label", F.lit("1")).alias("service"))
    return correlate.service_depends_on(g, e.withColumns({"repo_id": F.lit("r"), "label": F.lit("Imports")}), m)


@query(W_FACTS + f"SELECT DISTINCT workspace_id, {S_ID} AS id, service_name AS name FROM f")
def c11_apply_services(spark, sf_dir):
    s = A.load(spark, sf_dir, A.FACTS).select("workspace_id", F.col("service_name").alias("name"), F.lit("p").alias("purpose")).distinct()
    return correlate.apply_services(s).select("workspace_id", "id", "name")


@query(W_FACTS + f"SELECT DISTINCT workspace_id, CASE direction WHEN 'publish' THEN 'PUBLISHES' ELSE 'CONSUMES' END AS label, {S_ID} AS source_id, {V_ID} AS target_id FROM f WHERE direction <> 'none'")
def c12_apply_event_topology(spark, sf_dir):
    f = A.load(spark, sf_dir, A.FACTS)
    side = lambda d: F.collect_set(F.when(F.col("direction") == d, F.col("service_name")))
    found = f.groupBy("workspace_id", F.col("event_name").alias("event")).agg(side("publish").alias("publishers"), side("consume").alias("consumers"))
    return correlate.apply_event_topology(found).select("workspace_id", "label", "source_id", "target_id").distinct()


@query(W_FACTS + f"SELECT DISTINCT workspace_id, {S_ID} AS source_id, {C_ID} AS target_id FROM f")
def c13_apply_conventions(spark, sf_dir):
    found = A.load(spark, sf_dir, A.FACTS).groupBy("workspace_id", F.lit("storage").alias("category"), F.col("storage_name").alias("name")).agg(F.collect_set("service_name").alias("followed_by"))
    return correlate.apply_conventions(found).select("workspace_id", "source_id", "target_id")


def _manifests(spark, sf_dir) -> DataFrame:
    """A package.json per brand and a project file per type, naming packages of the parts."""
    p = A.load(spark, sf_dir, "SELECT 'ws0' AS workspace_id, 'r' || CAST(p_size % 7 AS STRING) AS repo_id, p_partkey, p_brand, p_type FROM part")
    npm = F.concat(F.lit('{"name": "n'), "repo_id", F.lit('", "dependencies": {"@org/'), F.lower(F.translate("p_brand", "#", "-")), F.lit('": "1"}}'))
    cs = F.concat(F.lit('<Project Sdk="Microsoft.NET.Sdk.Web"><PackageReference Include="Acme.'), "p_type", F.lit('" /></Project>'))
    odd = F.col("p_partkey") % 2 == 1
    return p.select("workspace_id", "repo_id", F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.when(odd, "/package.json").otherwise("/A.csproj")).alias("path"), F.when(odd, npm).otherwise(cs).alias("text"))


_PK = "SELECT DISTINCT 'ws0' AS workspace_id, 'r' || CAST(p_size % 7 AS VARCHAR) AS repo_id, CASE p_partkey % 2 WHEN 1 THEN '@org/' || lower(replace(p_brand, '#', '-')) ELSE 'Acme.' || p_type END AS package FROM part"


@query(_PK)
def c14_manifest_packages(spark, sf_dir):
    return correlate.manifest_packages(manifests.read_manifests(_manifests(spark, sf_dir), 1_000_000)).select("workspace_id", "repo_id", "package")


@query("SELECT 'ws0' AS workspace_id, 'r' || CAST(p_size % 7 AS VARCHAR) AS repo_id, CASE WHEN bool_or(p_partkey % 2 = 0) THEN 'backend' ELSE 'unknown' END AS kind FROM part GROUP BY ALL")
def c15_classify_repo_kind(spark, sf_dir):
    return correlate.classify_repo_kind(_manifests(spark, sf_dir))


@query(f"WITH p AS ({_PK}), n AS (SELECT *, count(*) OVER (PARTITION BY repo_id, substr(package, 1, 4)) AS c FROM p) SELECT workspace_id, repo_id, package, c >= 2 AS internal FROM n")
def c16_classify_internal(spark, sf_dir):
    return correlate.classify_internal(correlate.manifest_packages(_manifests(spark, sf_dir)))


@query("""SELECT 'ws0' AS workspace_id, 'r' || CAST(p_size % 7 AS VARCHAR) AS repo_id, CASE max(p_partkey % 2) WHEN 1 THEN 'nr' || CAST(p_size % 7 AS VARCHAR) ELSE 'A' END AS name,
    CASE max(p_partkey % 2) WHEN 1 THEN 'javascript' ELSE 'csharp' END AS language FROM part GROUP BY p_size % 7""")
def c17_repo_name_language(spark, sf_dir):
    return correlate.repo_name_language(_manifests(spark, sf_dir))


@query(f"""WITH p AS ({A.PACKAGES}), q AS (SELECT workspace_id, a.repo_id AS ra, b.repo_id AS rb, list_sort(list(lower(a.package))) AS l FROM p a JOIN p b USING (workspace_id, package) WHERE a.repo_id < b.repo_id GROUP BY ALL)
    SELECT workspace_id, 's' || ra AS source, 's' || rb AS target, 'transitive' AS signal, array_to_string(l[1:20], ',') AS shared FROM q""")
def c18_shared_packages(spark, sf_dir):
    p = A.load(spark, sf_dir, A.PACKAGES).withColumn("internal", F.lit(False))
    s = p.select("workspace_id", "repo_id", F.concat(F.lit("s"), "repo_id").alias("service")).distinct()
    return correlate.shared_packages(p, s).withColumn("shared", csv("shared"))


@query(f"SELECT workspace_id, lower(package) AS package, repo_id, p_internal AS internal, n AS members FROM (SELECT *, count(*) OVER (PARTITION BY workspace_id, package) AS n, starts_with(package, 'Brand1') AS p_internal FROM ({A.PACKAGES})) WHERE n > 1")
def c18_package_classes(spark, sf_dir):
    """The repositories of each shared package, a row for each member."""
    return correlate.package_classes(A.load(spark, sf_dir, A.PACKAGES).withColumn("internal", F.col("package").startswith("Brand1")))


@query(f"""WITH p AS ({A.PACKAGES}), q AS (SELECT workspace_id, a.repo_id AS ra, b.repo_id AS rb, list_sort(list(lower(a.package))) AS l FROM p a JOIN p b USING (workspace_id, package) WHERE a.repo_id < b.repo_id AND (a.repo_id IN ('repo3', 'repo5') OR b.repo_id IN ('repo3', 'repo5')) GROUP BY ALL)
    SELECT workspace_id, 's' || ra AS source, 's' || rb AS target, array_to_string(l[1:20], ',') AS shared FROM q""")
def c18_pairs_asked_for(spark, sf_dir):
    """Pairs that have one of two repositories."""
    p = A.load(spark, sf_dir, A.PACKAGES).withColumn("internal", F.lit(False))
    s = p.select("workspace_id", "repo_id", F.concat(F.lit("s"), "repo_id").alias("service")).distinct()
    return correlate.shared_packages(p, s, asked=p.where("repo_id in ('repo3', 'repo5')")).select("workspace_id", "source", "target", csv("shared").alias("shared"))


@query(W_FACTS + """SELECT workspace_id, repo_id, service_name AS service, array_to_string(list_sort(list(DISTINCT method || ' ' || path))[1:20], ',') AS endpoints,
    coalesce(string_agg(DISTINCT CASE direction WHEN 'publish' THEN event_name END, ',' ORDER BY CASE direction WHEN 'publish' THEN event_name END), '') AS published FROM f GROUP BY ALL""")
def c19_workspace_summary(spark, sf_dir):
    s = correlate.workspace_summary(A.parsed(spark, sf_dir))
    return s.select("workspace_id", "repo_id", "service", csv("endpoints").alias("endpoints"), csv("published").alias("published"))


@query(W_FACTS + "SELECT workspace_id, count(DISTINCT repo_id) AS repos, count(DISTINCT service_name) AS services, count(DISTINCT repo_id) >= 2 AS eligible FROM f GROUP BY ALL")
def c20_eligible_for_cross_repo(spark, sf_dir):
    return correlate.eligible_for_cross_repo(A.parsed(spark, sf_dir))


@query(W_FACTS + f"SELECT DISTINCT workspace_id, {S_ID} AS source_id, {guid_sql("'Service|' || workspace_id || '|c'")} AS target_id, 'e' AS evidence, 'cross-repo' AS inferred_by FROM f")
def c21_apply_calls(spark, sf_dir):
    calls = A.load(spark, sf_dir, A.FACTS).select("workspace_id", F.col("service_name").alias("caller"), F.lit("c").alias("callee"), F.lit("e").alias("evidence")).distinct()
    return correlate.apply_calls(calls).select("workspace_id", "source_id", "target_id", "props.evidence", "props.inferred_by")


@query(W_FACTS + """SELECT workspace_id, repo_id, 'storage' AS category, storage_name AS name, count(DISTINCT service_name) AS followers, any_value(t) AS services FROM f
    JOIN (SELECT workspace_id, repo_id, count(DISTINCT service_name) AS t FROM f GROUP BY ALL) USING (workspace_id, repo_id) GROUP BY workspace_id, repo_id, storage_name HAVING count(DISTINCT service_name) >= 0.5 * any_value(t)""")
def c22_majority_conventions(spark, sf_dir):
    return correlate.majority_conventions(A.parsed(spark, sf_dir))


_EV = ", m AS (SELECT DISTINCT workspace_id, repo_id, event_name AS event, direction FROM f WHERE direction <> 'none')"


@query(W_FACTS + _EV + " SELECT workspace_id, repo_id, event, CASE direction WHEN 'publish' THEN 'consumer' ELSE 'publisher' END AS missing_side FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.workspace_id = a.workspace_id AND b.event = a.event AND b.direction <> a.direction AND b.repo_id <> a.repo_id)")
def c23_one_sided_events(spark, sf_dir):
    return correlate.one_sided_events(A.parsed(spark, sf_dir))


@query(W_FACTS + """, m AS (SELECT DISTINCT workspace_id, repo_id, event_name AS event, direction FROM f WHERE file_path LIKE 'src/o1__/l%' AND direction <> 'none')
    SELECT workspace_id, repo_id, event, CASE direction WHEN 'publish' THEN 'consumer' ELSE 'publisher' END AS missing_side FROM m
    WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.workspace_id = m.workspace_id AND o.event = m.event AND o.direction <> m.direction AND o.repo_id <> m.repo_id)""")
def c23_one_sided_among_few(spark, sf_dir):
    """The same over the files of a hundred orders, where many events lack a side."""
    return correlate.one_sided_events(A.parsed(spark, sf_dir).where("file_path LIKE 'src/o1__/l%'"))


@query(W_FACTS + _EV + ", p AS (SELECT workspace_id, event, repo_id, string_agg(direction, '+' ORDER BY direction) AS p FROM m GROUP BY ALL) SELECT workspace_id, event, string_agg(DISTINCT p, ',' ORDER BY p) AS patterns FROM p GROUP BY ALL HAVING count(DISTINCT p) > 1")
def c24_direction_conflicts(spark, sf_dir):
    return correlate.direction_conflicts(A.parsed(spark, sf_dir)).withColumn("patterns", csv("patterns"))


@query(W_FACTS + "SELECT workspace_id, lower(replace(service_name, '#', '')) AS key, min(service_name) AS canonical, min(service_name) AS aliases, count(*) AS file_count, array_to_string(list_sort(list(DISTINCT file_path))[1:50], ',') AS source_files FROM f GROUP BY ALL")
def c25_merge_services(spark, sf_dir):
    return correlate.merge_services(A.parsed(spark, sf_dir)).withColumns({"aliases": csv("aliases"), "source_files": csv("source_files")})


@query(W_FACTS + """SELECT DISTINCT workspace_id, repo_id, substr(event_name || repeat('x', 60), 1, 50) AS kind, storage_name AS description, '["' || service_name || '"]' AS involved, 'open' AS status FROM f""")
def c26_record_conflicts(spark, sf_dir):
    f = A.load(spark, sf_dir, A.FACTS)
    c = f.select("workspace_id", "repo_id", F.concat("event_name", F.lit("x" * 60)).alias("kind"), F.col("storage_name").alias("description"), F.array("service_name").alias("involved")).distinct()
    return correlate.record_conflicts(c)


# --- questions ------------------------------------------------------------------------------------------------------
_Q = f"WITH q AS ({A.QUESTIONS}) "
_FP = "sha256(workspace_id || '|' || topic || '|' || question || '|a.cs|b' || CAST(id % 3 AS VARCHAR) || '.cs')"


def _questions(spark, sf_dir) -> DataFrame:
    q = A.load(spark, sf_dir, A.QUESTIONS)
    name = F.concat(F.lit("Supplier#00000000"), (F.col("id") % 12).cast("string"))
    b = F.concat(F.lit("b"), (F.col("id") % 3).cast("string"), F.lit(".cs"))
    out = q.withColumns({"related_file_paths": F.array(b, F.lit("a.cs")), "related_node_names": F.array(name), "source": F.lit("CrossFileCorrelation"), "answer": F.when(F.col("status") == "Answered", "yes").otherwise(F.lit(None).cast("string")), "answered_at": F.col("created_at")})
    return questions.with_fingerprint(out)


@query(_Q + f"SELECT id, {_FP} AS fingerprint FROM q")
def q1_fingerprint(spark, sf_dir):
    return _questions(spark, sf_dir).select("id", "fingerprint")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'high' WHEN 'click' THEN 'low' ELSE 'medium' END AS severity FROM events")
def q2_normalise_severity(spark, sf_dir):
    e = A.load(spark, sf_dir, "SELECT event_id, CASE event_type WHEN 'error' THEN ' HIGH' WHEN 'click' THEN 'Low' WHEN 'view' THEN 'x' END AS s FROM events")
    return e.select("event_id", questions.normalise_severity(F.col("s")).alias("severity"))


@query(W_GRAPH + f", q AS ({A.QUESTIONS}), h AS (SELECT workspace_id, k.i, count(n.id) AS c FROM (SELECT DISTINCT workspace_id, id % 12 AS i FROM q) k LEFT JOIN n USING (workspace_id) WHERE contains(lower(n.name), 'supplier#00000000' || k.i) GROUP BY ALL) SELECT q.id, least(coalesce(h.c, 0), 25) AS degree FROM q LEFT JOIN h ON h.workspace_id = q.workspace_id AND h.i = q.id % 12")
def q3_related_degree(spark, sf_dir):
    return questions.related_degree(_questions(spark, sf_dir), A.nodes(spark, sf_dir)).select("id", "degree")


@query(_Q + f", p AS (SELECT *, {_FP} AS fp FROM q), o AS (SELECT workspace_id, topic, count(DISTINCT fp) AS n, min(fp) AS one FROM p WHERE status = 'Open' GROUP BY ALL) SELECT id, coalesce(n > 1 OR one <> fp, false) AS blocks FROM p LEFT JOIN o USING (workspace_id, topic)")
def q4_blocks_others(spark, sf_dir):
    q = _questions(spark, sf_dir)
    return questions.blocks_others(q, q).select("id", "blocks")


@query(_Q + "SELECT id, CAST(greatest(0, least(100, 50 + CASE id % 3 WHEN 0 THEN 20 WHEN 1 THEN -10 ELSE 10 END + least(id % 40, 20) + least((id % 77) // 2, 15) + CASE id % 5 WHEN 0 THEN 5 ELSE 0 END + 10)) AS INT) AS priority FROM q")
def q5_priority(spark, sf_dir):
    q = _questions(spark, sf_dir)
    severity = F.when(F.col("id") % 3 == 0, "high").when(F.col("id") % 3 == 1, "low")
    return q.select("id", questions.priority(severity, F.col("id") % 40, F.col("id") % 77, F.col("id") % 5 == 0, F.col("source")).alias("priority"))


@query(_Q + f", p AS (SELECT *, {_FP} AS fp FROM q), k AS (SELECT DISTINCT workspace_id, fp FROM p WHERE id % 7 = 0) SELECT workspace_id, fp AS fingerprint, arg_min(id, (created_at, id)) AS id FROM p WHERE (workspace_id, fp) NOT IN (SELECT (workspace_id, fp) FROM k) GROUP BY ALL")
def q6_insert_new(spark, sf_dir):
    q = _questions(spark, sf_dir)
    return questions.insert_new(q.where("id % 7 = 0"), q).select("workspace_id", "fingerprint", "id")


_OLD = f"status = 'Open' AND created_at < {NOW} - INTERVAL 90 DAY"


@query(_Q + f"SELECT id, CASE WHEN {_OLD} THEN 'Dismissed' ELSE status END AS status, CASE WHEN {_OLD} THEN '[auto-dismissed] stale > 90d' WHEN status = 'Answered' THEN 'yes' END AS answer FROM q")
def q7_expire_stale(spark, sf_dir):
    return questions.expire_stale(_questions(spark, sf_dir), now()).select("id", "status", "answer")


@query(W_GRAPH + f""", q AS ({A.QUESTIONS}), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY created_at, id) AS r FROM q WHERE status = 'Open') WHERE r <= 200), h AS (SELECT DISTINCT n.workspace_id, i FROM range(12) r(i), n WHERE contains(lower(n.name), 'supplier#00000000' || i)),
    g AS (SELECT id FROM t WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.workspace_id = t.workspace_id AND h.i = t.id % 12))
    SELECT id, CASE WHEN id IN (FROM g) THEN 'Dismissed' ELSE status END AS status, CASE WHEN id IN (FROM g) THEN '[auto-dismissed] referenced nodes no longer exist' WHEN status = 'Answered' THEN 'yes' END AS answer FROM q""")
def q8_dismiss_orphaned(spark, sf_dir):
    return questions.dismiss_orphaned(_questions(spark, sf_dir), A.nodes(spark, sf_dir)).select("id", "status", "answer")


@query(W_GRAPH + "SELECT workspace_id, lower(replace(name, '#', '')) AS key, replace(name, '#', '-') || ',' || name AS names FROM n WHERE label = 'Service' AND replace(name, '#', '-') < name UNION ALL SELECT workspace_id, lower(replace(name, '#', '')), name || ',' || replace(name, '#', '-') FROM n WHERE label = 'Service' AND replace(name, '#', '-') > name")
def q9_duplicate_services(spark, sf_dir):
    """Every service has a second node whose name differs in punctuation."""
    nodes = A.nodes(spark, sf_dir)
    more = nodes.where("label = 'Service'").withColumns({"name": F.replace("name", F.lit("#"), F.lit("-")), "id": F.concat("id", F.lit("x"))})
    return questions.duplicate_services(nodes.unionByName(more)).select("workspace_id", "key", csv("names").alias("names"))


@query(W_GRAPH + ", t AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY path, method, id) AS r FROM n WHERE label = 'Endpoint'), d AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY path, method, id) AS k FROM t WHERE r <= 50 AND method = 'GET') SELECT workspace_id, id, method, path, '**Method:** `' || method || '`  ' || chr(10) || '**Path:** `' || path || '`  ' || chr(10) || chr(10) || 'No incoming CALLS edges were found in the graph, and no Service node EXPOSES this endpoint.' AS evidence, 'Remove it,Keep it,Add a caller' AS choices FROM d WHERE k <= 20")
def q10_dangling_endpoints(spark, sf_dir):
    """Endpoints read with GET lose their edges first."""
    nodes, edges = A.graph(spark, sf_dir)
    get = nodes.where("label = 'Endpoint' AND props['method'] = 'GET'").select("workspace_id", F.col("id").alias("target_id"))
    found = questions.dangling_endpoints(nodes, edges.join(get, ["workspace_id", "target_id"], "left_anti"))
    return found.select("workspace_id", "id", "method", "path", "evidence", csv("choices").alias("choices"))


@query(_Q + "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY workspace_id ORDER BY priority DESC, id) AS r FROM q) WHERE r <= 51")
def q11_cap_submissions(spark, sf_dir):
    return questions.cap_submissions(_questions(spark, sf_dir)).select("id")


@query(_Q + "SELECT id, topic, 'Files disagree on ' || topic || '. Which is correct?' AS question, 'f' || CAST(id % 12 AS VARCHAR) || '.cs' AS files FROM q")
def q12_conflict_questions(spark, sf_dir):
    q = _questions(spark, sf_dir)
    c = q.select("workspace_id", F.lit("r").alias("repo_id"), "id", F.col("topic").alias("kind"), F.lit("").alias("description"), F.array(F.col("related_node_names")[0], F.col("related_node_names")[0]).alias("involved"))
    s = q.select("workspace_id", F.lit("r").alias("repo_id"), F.col("related_node_names")[0].alias("service"), F.array(F.concat(F.lit("f"), (F.col("id") % 12).cast("string"), F.lit(".cs"))).alias("files")).distinct()
    return questions.conflict_questions(c, s).select("id", "topic", "question", csv("related_file_paths").alias("files"))


@query(_Q + "SELECT id, CASE id % 3 WHEN 0 THEN 'b0.cs' ELSE 'b0.cs,c.cs' END AS files FROM q")
def q13_ground_generated(spark, sf_dir):
    q = _questions(spark, sf_dir).withColumns({"evidence_files": F.array(F.lit("b0.cs"), F.lit("c.cs")), "evidence_nodes": F.col("related_node_names"), "choices": F.array(F.lit("x")), "related_file_paths": F.slice("related_file_paths", 1, 1)})
    return questions.ground_generated(q).select("id", csv("related_file_paths").alias("files"))


@query(_Q + "SELECT id, '- `Supplier#00000000' || (id % 12) || '`' || chr(10) AS evidence FROM q")
def q14_evidence_markdown(spark, sf_dir):
    return _questions(spark, sf_dir).select("id", questions.evidence_list(F.col("related_node_names")).alias("evidence"))


@query(_Q + "SELECT id, priority FROM q WHERE workspace_id = 'ws1' AND status = 'Open' ORDER BY priority DESC, created_at DESC, id LIMIT 50")
def q15_list_questions(spark, sf_dir):
    return questions.list_questions(_questions(spark, sf_dir), "ws1").select("id", "priority")


@query(_Q + "SELECT id, priority FROM q WHERE workspace_id = 'ws1' AND status IN ('Open', 'Answered') AND id % 12 = 3 ORDER BY priority DESC, id LIMIT 50")
def q16_questions_by_node(spark, sf_dir):
    return questions.questions_by_node(_questions(spark, sf_dir), "ws1", "Supplier#000000003").select("id", "priority")


@query(_Q + "SELECT workspace_id, 'b0.cs' AS path, id, r FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, id) AS r FROM q WHERE status = 'Answered' AND (id % 3 = 0 OR id % 12 = 1)) WHERE r <= 25")
def q17_answered_for_file(spark, sf_dir):
    q = _questions(spark, sf_dir)
    f = q.select("workspace_id", F.lit("b0.cs").alias("path"), F.array(F.lit("Supplier#000000001")).alias("names")).distinct()
    return questions.answered_for_files(q, f).select("workspace_id", "path", "id", F.col("r").cast("long").alias("r"))


@query(_Q + "SELECT id, CASE WHEN status = 'Open' AND id % 5 = 0 THEN 'Answered' ELSE status END AS status, CASE WHEN status = 'Open' AND id % 5 = 0 THEN 'sure' WHEN status = 'Answered' THEN 'yes' END AS answer FROM q")
def q18_answer(spark, sf_dir):
    q = _questions(spark, sf_dir)
    given = q.where("id % 5 <= 1").select("id", F.when(F.col("id") % 5 == 0, " sure ").otherwise("  ").alias("text"))
    return questions.answer(q, given, now())[0].select("id", "status", "answer")


@query(_Q + "SELECT id, CASE WHEN status = 'Open' AND id % 5 = 0 THEN 'Dismissed' ELSE status END AS status, CASE WHEN status = 'Open' AND id % 5 = 0 THEN '[dismissed] no' WHEN status = 'Answered' THEN 'yes' END AS answer FROM q")
def q19_dismiss(spark, sf_dir):
    q = _questions(spark, sf_dir)
    return questions.dismiss(q, q.where("id % 5 = 0").select("id", F.lit("no").alias("text")), now())[0].select("id", "status", "answer")


@query(_Q + "SELECT id, topic FROM q WHERE workspace_id = 'ws1' AND id = (SELECT min(id) FROM q WHERE workspace_id = 'ws1')")
def q20_get_question(spark, sf_dir):
    q = _questions(spark, sf_dir)
    return questions.get_question(q, "ws1", q.where("workspace_id = 'ws1'").agg(F.min("id")).first()[0]).select("id", "topic")


@query(_Q + "SELECT workspace_id, topic, question, 'medium' AS severity FROM q")
def q21_project_generated(spark, sf_dir):
    q = _questions(spark, sf_dir)
    pair = F.array(F.struct(F.concat(F.lit(" "), "topic").alias("topic"), "question", F.lit(None).cast("string").alias("severity")), F.struct(F.lit(" ").alias("topic"), "question", F.lit("high").alias("severity")))
    return questions.project_generated(q.select("workspace_id", pair.alias("questions")))


# --- skills and context ---------------------------------------------------------------------------------------------
def _skills(spark, sf_dir) -> DataFrame:
    return A.load(spark, sf_dir, A.SKILLS).withColumns({"triggers": F.array("trigger_text"), "body": F.col("name")})


_SK = f"s AS (SELECT * FROM ({A.SKILLS}) WHERE enabled), t AS (SELECT * FROM ({A.TASKS}) WHERE query_id % 100 = 0)"
_WORD = "CAST(len(list_filter(list_distinct(string_split_regex(lower({c}), '[ #]+')), lambda w: length(w) >= 4 AND contains(lower(query), w))) AS DOUBLE)"


@query(f"""WITH {_SK}, m AS (SELECT t.workspace_id, query_id, name, CASE WHEN contains(lower(query), lower(trigger_text)) THEN 3.0 ELSE 0.0 END + {_WORD.format(c='title')} + 0.5 * {_WORD.format(c='description')} AS score FROM t JOIN s USING (workspace_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, query_id ORDER BY score DESC, name) AS r FROM m WHERE score > 0) SELECT workspace_id, query_id, name, CAST(score * 2 AS BIGINT) AS score2, r FROM r WHERE r <= 3""")
def k1_match_skills(spark, sf_dir):
    tasks = A.load(spark, sf_dir, A.TASKS).where("query_id % 100 = 0")
    out = context.match_skills(_skills(spark, sf_dir), tasks)
    return out.select("workspace_id", "query_id", "name", (F.col("score") * 2).cast("long").alias("score2"), F.col("r").cast("long").alias("r"))


@query(f"WITH t AS ({A.TASKS}) SELECT query_id, array_to_string(list_filter(string_split(query, ' '), lambda w: length(w) >= 4 AND NOT list_contains(['with', 'from', 'over'], lower(w))), ',') AS tokens FROM t")
def k2_significant_tokens(spark, sf_dir):
    return context.task_tokens(A.load(spark, sf_dir, A.TASKS)).select("query_id", csv("tokens").alias("tokens"))


def _items(spark, sf_dir) -> DataFrame:
    """Items of all four buckets for each tenant and brand."""
    p = A.load(spark, sf_dir, "SELECT p_brand AS query_id, p_partkey AS pos, p_name AS item, p_size FROM part")
    bucket = F.element_at(F.array(*map(F.lit, ["skill", "graph", "file", "extraction"])), (F.col("pos") % 4 + 1).cast("int"))
    parts = {b: p.where(bucket == b).select("query_id", "pos", F.concat("item", F.col("pos").cast("string")).alias("item"), (F.col("p_size") * 10).alias("chars")) for b in ("skill", "graph", "file", "extraction")}
    return context.relevant_context(parts)


@query("SELECT p_brand AS query_id, CASE p_partkey % 4 WHEN 0 THEN 'skill' WHEN 1 THEN 'graph' WHEN 2 THEN 'file' ELSE 'extraction' END AS bucket, p_partkey AS pos, p_name || p_partkey AS item, p_size * 10 AS chars FROM part")
def k3_relevant_context(spark, sf_dir):
    return _items(spark, sf_dir)


_B = """WITH i AS (SELECT p_brand AS q, p_partkey AS pos, p_name || p_partkey AS item, CASE p_partkey % 4 WHEN 0 THEN 'skill' WHEN 1 THEN 'graph' WHEN 2 THEN 'file' ELSE 'extraction' END AS b, p_size * 10 AS chars FROM part),
    s AS (SELECT q, coalesce(sum(chars) FILTER (WHERE b = 'skill'), 0) AS sk, coalesce(sum(chars) FILTER (WHERE b = 'graph'), 0) AS gr, coalesce(sum(chars) FILTER (WHERE b = 'file'), 0) AS fi, coalesce(sum(chars) FILTER (WHERE b = 'extraction'), 0) AS ex FROM i GROUP BY q),
    d AS (SELECT *, ceil((sk + gr + fi + ex) / 4.0) > 400 AS dg FROM s), e AS (SELECT *, dg AND ceil((sk + fi + ex) / 4.0) > 400 AND ex > 0 AS dx FROM d), g AS (SELECT *, dg AND ceil((sk + fi + CASE WHEN dx THEN 0 ELSE ex END) / 4.0) > 400 AND fi > 0 AS tr FROM e),
    r AS (SELECT i.*, sum(chars) OVER (PARTITION BY q, b ORDER BY pos, item ROWS UNBOUNDED PRECEDING) AS run FROM i),
    k AS (SELECT r.* FROM r JOIN g USING (q) WHERE b = 'skill' OR (b = 'graph' AND NOT dg) OR (b = 'extraction' AND NOT dx) OR (b = 'file' AND (NOT tr OR ceil((sk + run) / 4.0) <= 400)))"""


@query(_B + " SELECT g.q AS query_id, coalesce(CAST(ceil(sum(chars) / 4.0) AS BIGINT), 0) AS estimate, any_value(dg) AS truncated, coalesce(string_agg(b || ':' || item, ',' ORDER BY b || ':' || item), '') AS kept FROM g LEFT JOIN k ON k.q = g.q GROUP BY ALL")
def k4_fit_budget(spark, sf_dir):
    kept, verdict = context.fit_budget(_items(spark, sf_dir), 400)
    lists = kept.groupBy("query_id").agg(csv(F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "item")))).alias("kept"))
    return verdict.join(lists, "query_id", "left").withColumn("kept", F.coalesce("kept", F.lit("")))


@query(f"SELECT id, 2 * length(name) + length(title) AS chars FROM ({A.SKILLS})")
def k5_count_chars(spark, sf_dir):
    return _skills(spark, sf_dir).select("id", context.skill_chars().alias("chars"))


@query(W_FACTS + """SELECT file_path, 'Part of service ''' || service_name || '''. Defines 1 HTTP endpoint(s).' || CASE direction WHEN 'publish' THEN ' Publishes 1 event(s).' WHEN 'consume' THEN ' Consumes 1 event(s).' ELSE '' END || ' Touches 1 storage backend(s). Declares 1 convention(s).' AS summary FROM f""")
def k6_file_summary(spark, sf_dir):
    return A.parsed(spark, sf_dir).select("file_path", context.file_summary().alias("summary"))


@query(W_FACTS + """SELECT file_path, unnest(list_filter(['endpoint:' || method || ':' || path, CASE direction WHEN 'publish' THEN 'event_publish:' || event_name || ':' || storage_name WHEN 'consume' THEN 'event_consume:' || event_name || ':' || storage_name END,
    'storage:' || storage_name || ':table:' || access, 'convention:storage:' || storage_name], lambda x: x IS NOT NULL)) AS component FROM f""")
def k7_component_list(spark, sf_dir):
    rows = A.parsed(spark, sf_dir).select("file_path", F.explode(context.component_list()).alias("x"))
    return rows.select("file_path", F.concat_ws(":", "x.kind", "x.a", "x.b", "x.c").alias("component"))


@query(W_FACTS + "SELECT file_path, method || ' ' || path AS endpoint, length(file_path) + length(method) + length(path) + CASE direction WHEN 'none' THEN 0 ELSE length(event_name) + length(storage_name) END AS chars FROM f")
def k8_extraction_hit(spark, sf_dir):
    h = context.extraction_hit(A.parsed(spark, sf_dir))
    return h.select("file_path", F.concat_ws(" ", F.col("endpoints")[0]["method"], F.col("endpoints")[0]["path"]).alias("endpoint"), context.hit_chars().alias("chars"))


@query(f"SELECT workspace_id, name, description FROM ({A.SKILLS}) WHERE enabled")
def k9_enabled_skills(spark, sf_dir):
    return context.enabled_skills(A.load(spark, sf_dir, A.SKILLS))


@query(f"SELECT id, name FROM ({A.SKILLS})")
def k10_list_skills(spark, sf_dir):
    return context.list_skills(A.load(spark, sf_dir, A.SKILLS).withColumn("body", F.lit("b"))).select("id", "name")


@query("SELECT p_partkey AS skill_id, 2 + n AS version, 'T' || n AS title, 'old' AS body FROM part, (VALUES (0), (1)) v(n)")
def k11_next_revision(spark, sf_dir):
    p = A.load(spark, sf_dir, "SELECT p_partkey AS skill_id FROM part")
    old = p.select("skill_id", F.lit(1).alias("version"), F.lit("t").alias("title"), F.lit("old").alias("body"))
    edits = p.select("skill_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("edited_at")).withColumns({"title": F.concat(F.lit("T"), F.col("edited_at").cast("string")), "body": F.lit(None).cast("string"), "change_note": F.lit("n")})
    return context.next_revision(old, edits).select("skill_id", "version", "title", "body")


@query("SELECT p_partkey AS skill_id, p_size AS version FROM part WHERE p_partkey = 7")
def k12_get_revision(spark, sf_dir):
    r = A.load(spark, sf_dir, "SELECT p_partkey AS skill_id, p_size AS version FROM part")
    size = r.where("skill_id = 7").agg(F.max("version")).first()[0]
    return context.get_revision(context.list_revisions(r), 7, size)


@query("SELECT p_partkey, p_brand || ',' || p_type AS triggers FROM part")
def k13_normalise_triggers(spark, sf_dir):
    p = A.load(spark, sf_dir, "SELECT p_partkey, p_brand, p_type FROM part")
    raw = F.array(F.concat(F.lit(" "), "p_brand"), F.lit("  "), F.lower("p_brand"), "p_type")
    return p.select("p_partkey", csv(context.normalise_triggers(raw)).alias("triggers"))


# --- reports --------------------------------------------------------------------------------------------------------
#: Percentages are compared in whole hundredths.
_PCT = "CAST(round_even(CAST({a} AS DOUBLE) * 10000 / {b}, 0) AS BIGINT)"


def hundredths(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, (F.col(column) * 100).cast("long"))


_S = f"WITH s AS (SELECT *, CASE WHEN status <> 'running' THEN started_at + to_seconds(id % 3600) END AS completed_at FROM ({A.SCANS})) "


def _scans(spark, sf_dir) -> DataFrame:
    s = A.load(spark, sf_dir, A.SCANS)
    return s.withColumn("completed_at", F.when(F.col("status") != "running", F.col("started_at") + F.make_interval(secs=F.col("id") % 3600)))


def _costed(spark, sf_dir) -> DataFrame:
    return A.load(spark, sf_dir, A.COSTED).withColumn("cost_usd", (F.col("cost_e8").cast("decimal(20,0)") / 100).cast("decimal(18,0)"))


def micro(df: DataFrame) -> DataFrame:
    """Costs as whole millionths of a dollar."""
    return df.withColumn("cost_micro", (F.col("cost_usd") * 1000000).cast("long")).drop("cost_usd")


@query(f"WITH r AS (SELECT workspace_id, repo_id, bool_or(status = 'running') AS busy FROM ({A.SCANS}) GROUP BY ALL) SELECT workspace_id, count(*) AS total, count(*) FILTER (WHERE busy) AS active FROM r GROUP BY ALL")
def p1_repo_summary(spark, sf_dir):
    repos = A.load(spark, sf_dir, A.SCANS).groupBy("workspace_id", "repo_id").agg(F.bool_or(F.col("status") == "running").alias("busy"))
    return reports.repo_summary(repos.withColumn("status", F.when(F.col("busy"), "active").otherwise("off")))


@query(_S + "SELECT workspace_id, max(started_at) AS last_scan_at FROM s GROUP BY ALL")
def p2_last_scan_at(spark, sf_dir):
    return reports.last_scan_at(_scans(spark, sf_dir)).withColumn("last_scan_at", F.col("last_scan_at").cast("timestamp_ntz"))


@query(f"WITH c AS ({A.CALLS}) SELECT workspace_id, {_PCT.format(a='count(*) FILTER (WHERE cache_hit)', b='count(*)')} AS cached_pct FROM c WHERE starts_with(purpose, 'Extraction') GROUP BY ALL")
def p3_cached_pct(spark, sf_dir):
    return hundredths(reports.cached_pct(A.load(spark, sf_dir, A.CALLS)), "cached_pct")


@query(_Q + "SELECT workspace_id, count(*) FILTER (WHERE status = 'Open') AS open, count(*) FILTER (WHERE status = 'Answered') AS answered, count(*) FILTER (WHERE status = 'Dismissed') AS dismissed FROM q GROUP BY ALL")
def p4_question_counts(spark, sf_dir):
    return reports.question_counts(A.load(spark, sf_dir, A.QUESTIONS))


@query(f"SELECT workspace_id, count(*) AS skills FROM ({A.SKILLS}) GROUP BY ALL")
def p5_skill_count(spark, sf_dir):
    return reports.skill_count(A.load(spark, sf_dir, A.SKILLS))


#: A call's cost in millionths of a dollar, rounded as the operator rounds it.
_MICRO = "((input_tokens::BIGINT * CASE model WHEN 'small' THEN 80 ELSE 300 END + output_tokens::BIGINT * CASE model WHEN 'small' THEN 400 ELSE 1500 END + 50) // 100)"
_SUMS = f"count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens // 2) AS BIGINT) AS cache_read_tokens, CAST(sum(output_tokens // 2) AS BIGINT) AS cache_write_tokens, CAST(sum({_MICRO}) AS BIGINT) AS cost_micro, {_PCT.format(a='count(*) FILTER (WHERE cache_hit)', b='count(*)')} AS hit_pct"


@query(f"WITH c AS ({A.CALLS}) SELECT workspace_id, purpose, {_SUMS} FROM c GROUP BY workspace_id, purpose UNION ALL SELECT workspace_id, 'total', {_SUMS} FROM c GROUP BY workspace_id")
def p6_spend_by_purpose(spark, sf_dir):
    c = A.load(spark, sf_dir, A.CALLS).withColumns({"cache_read_tokens": F.expr("input_tokens div 2"), "cache_write_tokens": F.expr("output_tokens div 2")})
    return micro(hundredths(reports.spend_by_purpose(extract.model_cost(c)), "hit_pct"))


_LAT = "CAST(round_even(quantile_cont(latency_ms, {p}), 0) AS INT)"


@query(f"WITH t AS ({A.TELEMETRY}) SELECT workspace_id, count(*) AS calls, {_LAT.format(p=0.5)} AS p50, {_LAT.format(p=0.95)} AS p95, {_PCT.format(a='count(*) FILTER (WHERE status_code >= 400)', b='count(*)')} AS error_pct FROM t GROUP BY ALL")
def p7_latency_stats(spark, sf_dir):
    return hundredths(reports.latency_stats(A.load(spark, sf_dir, A.TELEMETRY)), "error_pct")


@query(f"""WITH k AS (SELECT workspace_id, count(*) AS skills, count(*) AS total, count(*) FILTER (WHERE enabled) AS active FROM ({A.SKILLS}) GROUP BY ALL), q AS (SELECT workspace_id, count(*) FILTER (WHERE status = 'Open') AS open FROM ({A.QUESTIONS}) GROUP BY ALL),
    t AS (SELECT workspace_id, count(*) AS calls, {_LAT.format(p=0.95)} AS p95 FROM ({A.TELEMETRY}) GROUP BY ALL), l AS (SELECT workspace_id, count(*) AS llm_calls, CAST(sum({_MICRO}) AS BIGINT) AS cost_micro FROM ({A.CALLS}) GROUP BY ALL),
    {GRAPH}, g AS (SELECT workspace_id, count(*) FILTER (WHERE label = 'Service') AS services FROM n GROUP BY ALL), h AS (SELECT workspace_id, count(DISTINCT source_id || target_id) AS exposes FROM e WHERE label = 'EXPOSES' GROUP BY ALL)
    SELECT workspace_id, total, active, skills, open, calls, p95, llm_calls, cost_micro, services, exposes FROM k JOIN q USING (workspace_id) JOIN t USING (workspace_id) JOIN l USING (workspace_id) JOIN g USING (workspace_id) JOIN h USING (workspace_id)""")
def p8_summary(spark, sf_dir):
    skills = A.load(spark, sf_dir, A.SKILLS)
    repos = skills.withColumn("status", F.when(F.col("enabled"), "active").otherwise("off"))
    calls = extract.model_cost(A.load(spark, sf_dir, A.CALLS))
    graph = graph_read.overview(*A.graph(spark, sf_dir))
    out = reports.summary(repos, _scans(spark, sf_dir), calls, A.load(spark, sf_dir, A.QUESTIONS), skills, A.load(spark, sf_dir, A.TELEMETRY), graph)
    n = lambda kind, label: F.col(f"{kind}_counts")[label].cast("long")
    cost = (F.col("llm_cost_usd") * 1000000).cast("long").alias("cost_micro")
    return out.select("workspace_id", "total", "active", "skills", "open", "calls", "p95", "llm_calls", cost, n("node", "Service").alias("services"), n("edge", "EXPOSES").alias("exposes"))


@query(_S + "SELECT id, status FROM s WHERE workspace_id = 'ws1' AND repo_id = 'repo2' ORDER BY started_at DESC, id LIMIT 20")
def p9_list_scans(spark, sf_dir):
    return reports.list_scans(_scans(spark, sf_dir), "ws1", "repo2").select("id", "status")


@query(_S + "SELECT id, CASE WHEN completed_at IS NOT NULL THEN (id % 3600) * 1000 ELSE -1 END AS duration_ms FROM s")
def p10_scan_detail(spark, sf_dir):
    return reports.scan_detail(_scans(spark, sf_dir)).select("id", F.coalesce("duration_ms", F.lit(-1)).cast("long").alias("duration_ms"))


@query(f"WITH c AS ({A.CALLS}) SELECT workspace_id, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS calls, count(*) FILTER (WHERE cache_hit) AS cached, CAST(sum({_MICRO}) AS BIGINT) AS cost_micro FROM c WHERE created_at >= date_trunc('day', {NOW}) - INTERVAL 29 DAY AND created_at <= {NOW} GROUP BY ALL")
def p11_daily_spend(spark, sf_dir):
    return micro(reports.daily_spend(extract.model_cost(A.load(spark, sf_dir, A.CALLS)), now()))


@query(f"WITH t AS ({A.TELEMETRY}) SELECT workspace_id, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS calls, count(*) FILTER (WHERE status_code >= 400) AS errors, {_LAT.format(p=0.95)} AS p95 FROM t WHERE created_at >= date_trunc('day', {EVENTS_NOW}) - INTERVAL 6 DAY AND created_at <= {EVENTS_NOW} GROUP BY ALL")
def p12_daily_activity(spark, sf_dir):
    t = A.load(spark, sf_dir, A.TELEMETRY)
    return reports.daily_activity(t, F.lit(t.agg(F.max("created_at")).first()[0]).cast("timestamp"))


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS running, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed_hour, count(*) FILTER (WHERE o_orderstatus = 'P') AS succeeded_hour, 0 AS queued, 0 AS scheduled FROM orders")
def p13_job_status(spark, sf_dir):
    jobs = A.load(spark, sf_dir, "SELECT CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'failed' ELSE 'succeeded' END AS state FROM orders").withColumn("ended_at", now())
    return reports.job_status(jobs, now())


@query(_S + "SELECT DISTINCT workspace_id, repo_id FROM s")
def p14_list_repos(spark, sf_dir):
    return reports.list_repos(_scans(spark, sf_dir).groupBy("workspace_id", "repo_id").agg(F.min("started_at").alias("created_at"))).select("workspace_id", "repo_id")


@query(_S + f", q AS ({A.QUESTIONS}) SELECT kind, ref FROM (SELECT 'scan-started' AS kind, CAST(id AS VARCHAR) AS ref, started_at AS t FROM s UNION ALL SELECT 'scan-ended', CAST(id AS VARCHAR), completed_at FROM s WHERE completed_at IS NOT NULL UNION ALL SELECT 'question', CAST(id AS VARCHAR), created_at FROM q) ORDER BY t DESC, kind, ref LIMIT 15")
def p15_activity_feed(spark, sf_dir):
    return reports.activity_feed(_scans(spark, sf_dir), A.load(spark, sf_dir, A.QUESTIONS)).select("kind", "ref")


@query("SELECT c_custkey AS user_id, 'w' || c_nationkey AS workspace_id, n_name AS slug FROM customer JOIN nation ON c_nationkey = n_nationkey")
def p16_member_workspaces(spark, sf_dir):
    m = A.load(spark, sf_dir, "SELECT c_custkey AS user_id, 'w' || CAST(c_nationkey AS STRING) AS workspace_id FROM customer")
    return reports.member_workspaces(A.load(spark, sf_dir, "SELECT 'w' || CAST(n_nationkey AS STRING) AS workspace_id, n_name AS slug FROM nation"), m)


@query(W_GRAPH + "SELECT workspace_id, (SELECT count(*) FROM n b WHERE b.workspace_id = a.workspace_id) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT workspace_id, label, source_id, target_id FROM e) b WHERE b.workspace_id = a.workspace_id) AS edges FROM (SELECT DISTINCT workspace_id FROM n) a")
def p17_graph_totals(spark, sf_dir):
    t = reports.graph_totals(graph_read.overview(*A.graph(spark, sf_dir)))
    return t.select("workspace_id", F.col("nodes").cast("long").alias("nodes"), F.col("edges").cast("long").alias("edges"))


@query("SELECT c_custkey AS id, c_name AS prefix FROM customer")
def p18_list_api_keys(spark, sf_dir):
    return reports.list_api_keys(A.load(spark, sf_dir, "SELECT c_custkey AS id, c_name AS prefix, 'h' AS key_hash, c_acctbal AS created_at FROM customer")).select("id", "prefix")


# --- changes --------------------------------------------------------------------------------------------------------
@query(f"SELECT workspace_id, repo_id, CASE id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'initial' ELSE 'diff' END AS action, count(*) AS n FROM ({A.SCANS}) WHERE status <> 'running' GROUP BY ALL")
def d1_detect_changed_repos(spark, sf_dir):
    s = A.load(spark, sf_dir, A.SCANS)
    own = s.select("workspace_id", F.concat_ws("/", "repo_id", F.col("id").cast("string")).alias("repo_id"), F.when(F.col("status") == "running", "scanning").otherwise("ok").alias("status"), F.when(F.col("id") % 3 == 0, "ABC").when(F.col("id") % 3 == 2, "old").alias("last_processed_sha"))
    out = changes.detect_changed_repos(own, own.select("workspace_id", "repo_id", F.lit("abc").alias("head_sha")))
    return out.groupBy("workspace_id", F.substring_index("repo_id", "/", 1).alias("repo_id"), "action").agg(F.count(F.lit(1)).alias("n"))


_CH = f"WITH c AS ({A.CHANGES}) "


@query(_CH + "SELECT repo_id, 'extract' AS action, filename AS path FROM c WHERE status <> 'removed' UNION ALL SELECT repo_id, 'prune', filename FROM c WHERE status = 'removed' UNION ALL SELECT repo_id, 'prune', previous_filename FROM c WHERE status = 'renamed'")
def d2_route_changes(spark, sf_dir):
    return changes.route_changes(A.load(spark, sf_dir, A.CHANGES))


@query(_CH + "SELECT repo_id, filename, n > 500 AS capped FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY filename) AS r, count(*) OVER (PARTITION BY repo_id) AS n FROM c) WHERE r <= 500")
def d3_cap_diff(spark, sf_dir):
    return changes.cap_diff(A.load(spark, sf_dir, A.CHANGES)).select("repo_id", "filename", "capped")


def _table(spark, sf_dir, h: str) -> DataFrame:
    return A.load(spark, sf_dir, A.FACTS).select("workspace_id", "repo_id", "file_path", F.lit(h).alias("content_hash"), now().alias("created_at"))


@query(W_FACTS + "SELECT DISTINCT workspace_id, repo_id, file_path, CASE WHEN contains(file_path, '/l2.') THEN 'new' ELSE 'old' END AS content_hash FROM f WHERE NOT contains(file_path, '/l1.')")
def d4_incremental_update(spark, sf_dir):
    old = _table(spark, sf_dir, "old").distinct()
    routed = old.where(F.col("file_path").contains("/l1.")).select("repo_id", F.lit("prune").alias("action"), F.col("file_path").alias("path"))
    return changes.incremental_update(old, routed, old.where(F.col("file_path").contains("/l2.")).withColumn("content_hash", F.lit("new"))).select("workspace_id", "repo_id", "file_path", "content_hash")


@query(W_FACTS + "SELECT repo_id, CASE repo_id WHEN 'repo3' THEN 'new' ELSE 'old' END AS content_hash, count(*) AS n FROM f GROUP BY ALL")
def d5_full_rescan(spark, sf_dir):
    return changes.full_rescan(_table(spark, sf_dir, "old"), "repo3", _table(spark, sf_dir, "new")).groupBy("repo_id", "content_hash").agg(F.count(F.lit(1)).alias("n"))


@query(_S + "SELECT id, status, length(repeat('x', 4000)) AS error_length, completed_at IS NOT NULL AS ended FROM s")
def d6_scan_run_row(spark, sf_dir):
    s = changes.scan_run_row(_scans(spark, sf_dir).withColumn("error_message", F.repeat(F.lit("x"), F.lit(5000))), now())
    return s.select("id", "status", F.length("error_message").cast("long").alias("error_length"), F.col("completed_at").isNotNull().alias("ended"))


@query(W_FACTS + "SELECT DISTINCT workspace_id, repo_id, file_path, 'new' AS content_hash FROM f")
def s11_upsert_extractions(spark, sf_dir):
    return changes.upsert_extractions(_table(spark, sf_dir, "old").distinct(), _table(spark, sf_dir, "new").distinct()).select("workspace_id", "repo_id", "file_path", "content_hash")


# --- sources and sinks ----------------------------------------------------------------------------------------------
def _graph_texts(spark, sf_dir) -> DataFrame:
    """One node-link JSON per supplier, with aliases, numbers as ids and a bad edge."""
    e = A.load(spark, sf_dir, "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem")
    nodes = F.concat(F.lit('{"graph": {"vertices": [{"key": '), F.col("l_suppkey").cast("string"), F.lit(', "title": "s"},'), F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda p: F.concat(F.lit('{"id": "p'), p.cast("string"), F.lit('", "type": "part"}'))), ","))
    links = F.concat(F.lit('], "links": [{"from": "x"},'), F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda p: F.concat(F.lit('{"from": "s", "to": "p'), p.cast("string"), F.lit('"}'))), ","), F.lit("]}, \"version\": 3}"))
    return e.groupBy("l_suppkey").agg(F.concat(nodes, links).alias("text")).select(F.concat(F.lit("r"), F.col("l_suppkey").cast("string")).alias("repo_id"), "text")


_SP = "WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) "


@query(_SP + "SELECT 'r' || l_suppkey AS repo_id, count(*) + 1 AS nodes, count(*) AS edges, 1 AS bad FROM e GROUP BY l_suppkey")
def s3_read_structural_graph(spark, sf_dir):
    n, e, bad = readers.structural_rows(_graph_texts(spark, sf_dir))
    count = lambda df, c: df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(c))
    return count(n, "nodes").join(count(e, "edges"), "repo_id").join(count(bad, "bad"), "repo_id")


@query(ORACLE_SQL["s3_read_structural_graph"])
def s3_read_graph_files(spark, sf_dir):
    """The same graphs from files, a file for each repository, read in pieces."""
    path = A.scratch(spark, "graphs")
    texts = _graph_texts(spark, sf_dir).select("repo_id", "text")
    texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "repo_id").write.partitionBy("repo_id").text(path)
    n, e, bad = readers.read_structural_graph(spark, path)
    count = lambda df, c: df.groupBy(F.substring_index("repo_id", "=", -1).alias("repo_id")).agg(F.count(F.lit(1)).alias(c))
    return count(n, "nodes").join(count(e, "edges"), "repo_id").join(count(bad, "bad"), "repo_id")


@query(_SP + "SELECT 'r' || l_suppkey AS repo_id, '3' AS schema_version, count(*) + 1 AS total_nodes, count(*) + 1 AS total_edges FROM e GROUP BY l_suppkey")
def s4_structural_metadata(spark, sf_dir):
    return readers.structural_metadata(_graph_texts(spark, sf_dir), now()).select("repo_id", "schema_version", "total_nodes", "total_edges")


@query("SELECT event_id, 'k' AS keys FROM events")
def s5_property_bag(spark, sf_dir):
    e = A.load(spark, sf_dir, "SELECT event_id, props FROM events").withColumn("raw", F.regexp_replace("props", "^\\{", '{"id": 1, "z": null, '))
    return e.select("event_id", csv(F.map_keys(readers.property_bag(F.col("raw"), ["id"]))).alias("keys"))


@query(W_FACTS + "SELECT workspace_id, service_name, count(*) AS n FROM f GROUP BY ALL")
def s6_parse_extractions(spark, sf_dir):
    """A tenth of the rows is repeated as broken JSON, which is skipped."""
    e = A.extractions(spark, sf_dir)
    broken = e.withColumn("extraction_payload", F.substring("extraction_payload", 1, 30))
    p = project.parse_extractions(e.unionByName(broken))
    return p.groupBy("workspace_id", F.col("rec.service.serviceName").alias("service_name")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH m AS (SELECT 'r' || CAST(p_size % 7 AS VARCHAR) AS repo_id, row_number() OVER (PARTITION BY p_size % 7 ORDER BY 'm' || p_partkey || CASE p_partkey % 2 WHEN 1 THEN '/package.json' ELSE '/A.csproj' END) AS r FROM part) SELECT repo_id, count(*) AS n FROM m WHERE r <= 10 GROUP BY ALL")
def s7_read_manifests(spark, sf_dir):
    return manifests.read_manifests(_manifests(spark, sf_dir), 10).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))


@query(_CH + "SELECT filename, coalesce(previous_filename, '') AS previous_filename, 0 AS additions FROM c")
def s8_read_file_changes(spark, sf_dir):
    c = A.load(spark, sf_dir, A.CHANGES).withColumns({"additions": F.lit(None).cast("int"), "deletions": F.lit(1)})
    return changes.read_file_changes(c).select("filename", "previous_filename", "additions")


@query(f"WITH t AS ({A.TELEMETRY}) SELECT id, method, 4000 AS error_length FROM t")
def s10_append_telemetry(spark, sf_dir):
    t = A.load(spark, sf_dir, A.TELEMETRY).withColumn("error", F.repeat(F.lit("e"), F.lit(4100)))
    return writers.telemetry_rows(t, now()).select("id", "method", F.length("error").alias("error_length"))


@query("""SELECT '{"nNationkey":' || n_nationkey || ',"nName":"' || n_name || '"}' AS json FROM nation""")
def s12_to_wire_json(spark, sf_dir):
    return writers.to_wire_json(A.load(spark, sf_dir, "SELECT n_nationkey, n_name, CAST(NULL AS STRING) AS gone FROM nation"))


@query("SELECT lang || '/' || doc_id % 3 AS folder, count(*) AS lines, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY ALL")
def s1_read_source_tree(spark, sf_dir):
    """A working tree of small files, one folder below the other, is written first."""
    path = A.scratch(spark, "tree")
    docs = A.load(spark, sf_dir, "SELECT lang, doc_id % 3 AS part, CAST(doc_id AS STRING) AS value FROM documents")
    docs.repartition("lang", "part").write.partitionBy("lang", "part").text(path)
    tree = readers.read_source_tree(spark, path).where("not startswith(path, '_')")
    folder = F.concat_ws("/", F.regexp_extract("path", "^lang=([^/]*)/part=([^/]*)/", 1), F.regexp_extract("path", "^lang=([^/]*)/part=([^/]*)/", 2))
    ids = tree.select(folder.alias("folder"), F.explode(F.split(F.col("text"), "\n")).alias("id")).where("id <> ''")
    return ids.groupBy("folder").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("id").cast("long")).alias("ids"))


@query(f"SELECT id, workspace_id, method FROM ({A.TELEMETRY}) WHERE workspace_id = 'ws1'")
def s2_read_table(spark, sf_dir):
    path = A.scratch(spark, "telemetry")
    writers.write_tenant_table(A.load(spark, sf_dir, A.TELEMETRY), path)
    return readers.read_table(spark, path, "ws1").select("id", "workspace_id", "method")


@query(f"SELECT repo_id, 'node' AS kind, count(*) AS n, min(id) AS first FROM ({A.GNODES}) GROUP BY repo_id UNION ALL SELECT 'all', 'edge', count(*), min(source_id) FROM ({A.GEDGES})")
def s9_write_combined_graph(spark, sf_dir):
    """What was written is read back; folder names become the repository again."""
    path = A.scratch(spark, "combined")
    writers.write_combined_graph(A.load(spark, sf_dir, A.GNODES), A.load(spark, sf_dir, A.GEDGES).withColumn("repo_id", F.lit("all")), path)
    side = lambda kind, first: spark.read.parquet(f"{path}/{kind}s").groupBy("repo_id").agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))
    return side("node", "id").union(side("edge", "source_id"))


@query(W_FACTS + f"SELECT DISTINCT workspace_id, 'Queue' AS label, {Q_ID} AS id, event_name AS name, 'CONSUMES' AS edge, {S_ID} AS service_id FROM f")
def g14_project_msg_consumes(spark, sf_dir):
    f, none = A.load(spark, sf_dir, A.FACTS), F.lit(None).cast("string")
    own = F.array(F.struct(F.lit("RabbitMQ").alias("kind"), F.col("event_name").alias("exchange"), none.alias("routingKey"), none.alias("topic"), none.alias("queue"), none.alias("messageType")))
    service = F.struct(F.lit(True).alias("isPartOfService"), F.col("service_name").alias("serviceName"))
    rows = f.select("workspace_id", "repo_id", "file_path", F.lit("h").alias("content_hash"), F.struct(service.alias("service"), F.struct(own.alias("messagingConsumes")).alias("integrationContracts")).alias("rec"))
    return project.facts(rows, ["msg_consumes"]).select("workspace_id", "x.label", "x.id", "x.name", "x.edge", "service_id").distinct()


# --- streams, replayed to their end ---------------------------------------------------------------------------------
def _events(spark, sf_dir) -> DataFrame:
    """A stream of the events table."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return e.select(F.concat(F.lit("ws"), (F.col("user_id") % 4).cast("string")).alias("workspace_id"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"), F.floor("value").cast("int").alias("latency_ms"), F.col("ts").cast("timestamp").alias("created_at"))


def _drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there and reads its result."""
    spark = stream.sparkSession
    path = A.scratch(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out/batch=*")


@query("SELECT 'ws' || (user_id % 4) AS workspace_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY ALL")
def st1_stream_daily_activity(spark, sf_dir):
    return _drain(streams.stream_daily_activity(_events(spark, sf_dir)), "st1", "update").drop("p95")


@query("SELECT 'ws' || (user_id % 4) AS workspace_id, count(*) * 12 AS calls FROM events GROUP BY ALL")
def st7_stream_rate_of_errors(spark, sf_dir):
    """Every event lies in twelve sliding windows."""
    out = _drain(streams.stream_rate_of_errors(_events(spark, sf_dir)), "st7", "update")
    return out.groupBy("workspace_id").agg(F.sum("calls").cast("long").alias("calls"))


def _stream(spark, sf_dir, table: str, sql: str) -> DataFrame:
    """A stream of a table, projected by ``sql`` over the view ``feed``."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir).createOrReplaceTempView("feed")
    return spark.sql(sql)


_FEED = A.CHANGES.replace("FROM orders", "FROM feed")
_TOUCHED = f"t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY filename) AS r FROM ({A.CHANGES})) WHERE r <= 500 AND status <> 'removed')"


@query(f"WITH {_TOUCHED} SELECT repo_id, filename AS file_path, {guid_sql("'Service|ws|' || filename")} AS service_id, true AS extracted FROM t")
def st2_stream_file_changes(spark, sf_dir):
    """Every changed file names itself as its service; the tables after the last batch hold one extraction and node each."""
    path = A.scratch(spark, "st2")
    feed = _stream(spark, sf_dir, "orders", _FEED).withColumns({"additions": F.lit(None).cast("int"), "deletions": F.lit(1)})
    files = A.load(spark, sf_dir, A.CHANGES).select("repo_id", F.col("filename").alias("path"), F.lit(10).alias("length"), F.lit("text").cast("binary").alias("content"))
    payload = F.to_json(F.struct(F.struct(F.lit(True).alias("isPartOfService"), F.col("path").alias("serviceName")).alias("service")))

    def extract_files(todo: DataFrame) -> DataFrame:
        return todo.select(F.lit("ws").alias("workspace_id"), "repo_id", F.col("path").alias("file_path"), F.lit("h").alias("content_hash"), payload.alias("extraction_payload"), now().alias("created_at"))

    start = {"extractions": extract_files(files.limit(0)), "nodes": spark.createDataFrame([], NODES), "edges": spark.createDataFrame([], EDGES)}
    writer = streams.stream_incremental_update(feed, files, extract_files, start, f"{path}/tables", f"{path}/checkpoint", now())
    run = writer.trigger(availableNow=True).start()
    run.awaitTermination()
    tables = streams.read_incremental(spark, f"{path}/tables", {name: df.schema for name, df in start.items()})
    found = tables["extractions"].select("repo_id", "file_path", F.lit(True).alias("extracted"))
    nodes = tables["nodes"].where("label = 'Service'").select("repo_id", "file_path", F.col("id").alias("service_id"))
    return nodes.join(found, ["repo_id", "file_path"], "full_outer").select("repo_id", "file_path", "service_id", F.coalesce("extracted", F.lit(False)).alias("extracted"))


@query(f"WITH c AS ({A.CHANGES}) SELECT repo_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS changes FROM c WHERE ts < (SELECT max(ts) FROM c) GROUP BY ALL")
def st3_settle(spark, sf_dir):
    """A day's changes of a repository are a burst of their own; that of the last day has not been quiet yet."""
    feed = _stream(spark, sf_dir, "orders", _FEED).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _drain(streams.settle(feed), "st3", "append")
    return out.select("repo_id", F.date_format("started", "yyyy-MM-dd").alias("day"), "changes")


@query(_Q + "SELECT DISTINCT workspace_id, topic || question AS fingerprint FROM q WHERE question <> 'Question 7'")
def st4_stream_dedupe_questions(spark, sf_dir):
    feed = _stream(spark, sf_dir, "orders", A.QUESTIONS.replace("FROM orders o", "FROM feed o")).withColumns({"fingerprint": F.concat("topic", "question"), "created_at": F.col("created_at").cast("timestamp")})
    known = A.load(spark, sf_dir, A.QUESTIONS).where("question = 'Question 7'").select("workspace_id", F.concat("topic", "question").alias("fingerprint")).distinct()
    return _drain(streams.stream_dedupe_questions(feed, known), "st4", "append").select("workspace_id", "fingerprint")


@query("""WITH h AS (SELECT DISTINCT 'r' || o_custkey AS repo_id, strftime(o_orderdate, '%Y-%m') AS m FROM orders), p AS (SELECT *, lag(m) OVER (PARTITION BY repo_id ORDER BY m) AS b FROM h)
    SELECT repo_id, CASE WHEN b IS NULL THEN 'initial' ELSE 'diff' END AS action, coalesce(b, '-') AS from_sha, m AS to_sha FROM p""")
def st5_track_heads(spark, sf_dir):
    """A repository's head is the month of its latest order."""
    feed = _stream(spark, sf_dir, "orders", "SELECT 'r' || CAST(o_custkey AS STRING) AS repo_id, date_format(o_orderdate, 'yyyy-MM') AS head_sha, CAST(o_orderdate AS TIMESTAMP) AS ts FROM feed")
    held = {k: spark.conf.get(k, None) for k in streams.ROCKSDB}
    try:
        for k, v in streams.ROCKSDB.items():
            spark.conf.set(k, v)
        out = _drain(streams.track_heads(feed), "st5", "append")
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return out.withColumn("from_sha", F.coalesce("from_sha", F.lit("-")))


@query(_Q + f"SELECT 'question' AS kind, CASE WHEN {_OLD} THEN 'Dismissed' ELSE status END AS state, count(*) AS n FROM q GROUP BY ALL UNION ALL SELECT 'candidate', 'duplicate_service', (SELECT count(DISTINCT (workspace_id, service_name)) FROM ({A.FACTS}))")
def st6_sweep(spark, sf_dir):
    """One sweep over all questions: none is orphaned, as every name is a node's; every service has a twin; no endpoint dangles."""
    q = _questions(spark, sf_dir).withColumn("related_node_names", F.array(F.lit("Brand#")))
    nodes, edges = A.graph(spark, sf_dir)
    twins = nodes.where("label = 'Service'").withColumns({"name": F.replace("name", F.lit("#"), F.lit("-")), "id": F.concat("id", F.lit("x"))})
    path = A.scratch(spark, "st6")
    ticks = _stream(spark, sf_dir, "region", f"SELECT {NOW} AS ts FROM feed")
    writer = streams.stream_sweep(ticks, lambda: (q, nodes.unionByName(twins), edges), f"{path}/out", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    done, new = (spark.read.parquet(f"{path}/out/0/{name}") for name in ("questions", "candidates"))
    count = lambda df, kind, state: df.groupBy(F.lit(kind).alias("kind"), state.alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return count(done, "question", F.col("status")).union(count(new, "candidate", F.substring_index("topic", ":", 1)))

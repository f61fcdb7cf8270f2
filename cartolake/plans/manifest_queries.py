"""Registered queries of the fold over manifests, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.operators import manifests as M
from cartolake.plans import adapters as A
from cartolake.plans.queries import csv, query

#: Twelve kinds of manifests in five folders, some 20 for each repository at the middle size.
PARTS = """SELECT 'ws0' AS workspace_id, 'r' || CAST(p_partkey % 101 AS STRING) AS repo_id, p_partkey AS k, p_partkey % 12 AS v, p_brand AS brand, p_type AS kind, CASE p_partkey % 5
    WHEN 0 THEN 'm' WHEN 1 THEN 'vendor' WHEN 2 THEN 'coverage/x' WHEN 3 THEN 'Node_Modules' ELSE '.config' END || '/k' || CAST(p_partkey AS STRING) || '/' || CASE
    WHEN p_partkey % 12 < 4 OR p_partkey % 12 = 11 THEN 'package.json' WHEN p_partkey % 12 < 9 THEN 'P' || CAST(p_partkey AS STRING) || '.csproj'
    WHEN p_partkey % 12 = 9 THEN 'Directory.Packages.props' ELSE 'pyproject.toml' END AS path FROM part"""
_TEXTS = {
    0: '{{"name": "n{k}", "dependencies": {{"react-native": "1", "{brand}": "2"}}}}',
    1: '{{"dependencies": {{"foo": "1.0.0-next.1"}}, "devDependencies": {{"vue": "3"}}}}',
    2: '{{"name": "n{k}", "dependencies": {{"@angular/core": "1"}}}}',
    3: '{{"name": "n{k}", "scripts": {{"start": "Node server"}}, "peerDependencies": {{"angular-ui": "1", "{brand}": "1"}}}}',
    4: '<Project Sdk="Microsoft.NET.Sdk.Web"><ItemGroup><PackageReference Version="1" Include="Acme.{kind}" /></ItemGroup></Project>',
    5: '<Project Sdk="Microsoft.NET.Sdk"><PackageReference Include="Acme.{kind}" /><PackageReference Include="ACME.Common" /></Project>',
    6: '<Project><Choose><When><PackageReference Update="Hangfire.Core" /></When></Choose></Project>',
    7: '<Project><PackageReference Include="Microsoft.Extensions.Hosting" /><PackageReference Include="Microsoft.AspNetCore.App" /></Project>',
    8: '<Project Sdk="Microsoft.NET.Sdk.Web"><PackageReference Include="Lost.Package" />',
    9: '<Project><PackageVersion Include="Acme.None" /><PackageReference Include="acme.common" /></Project>',
    10: '[project]\n  name = "tool{k}"\nnumpy>=1\n# pandas>1\n',
    11: '{{"name": "n{k}", "dependencies": {{"lost": 1}}',
}


def files(spark, sf_dir) -> DataFrame:
    """Manifest files of the parts."""
    p = A.load(spark, sf_dir, PARTS)
    text = F.lit(None).cast("string")
    for v, t in _TEXTS.items():
        made = F.lit(t.format(k="<k>", brand="<brand>", kind="<kind>"))
        for c in ("k", "brand", "kind"):
            made = F.replace(made, F.lit(f"<{c}>"), F.col(c).cast("string"))
        text = F.when(F.col("v") == v, made).otherwise(text)
    return p.select("workspace_id", "repo_id", "path", text.alias("text"))


def facts(spark, sf_dir) -> DataFrame:
    return M.manifest_facts(M.read_manifests(files(spark, sf_dir)))


_READ = f"""WITH p AS ({PARTS}), o AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY CASE WHEN v < 4 OR v = 11 THEN 0 WHEN v < 9 THEN 1 WHEN v = 9 THEN 2 ELSE 3 END, path) AS no
    FROM p WHERE path NOT LIKE 'Node_Modules/%'), r AS (SELECT * FROM o WHERE no <= {{files}}),"""
#: What each kind of manifest names, in order.
_NAMES = """ x AS (SELECT *, unnest(CASE v WHEN 0 THEN ['react-native', brand] WHEN 1 THEN ['foo', 'vue'] WHEN 2 THEN ['@angular/core'] WHEN 3 THEN ['angular-ui', brand]
        WHEN 4 THEN ['Acme.' || kind] WHEN 5 THEN ['Acme.' || kind, 'ACME.Common'] WHEN 6 THEN ['Hangfire.Core'] WHEN 7 THEN ['Microsoft.Extensions.Hosting', 'Microsoft.AspNetCore.App']
        WHEN 9 THEN ['acme.common'] WHEN 10 THEN ['name', 'numpy'] ELSE [] END) AS package, generate_subscripts(CASE v WHEN 0 THEN [1, 2] WHEN 1 THEN [1, 2] WHEN 2 THEN [1]
        WHEN 3 THEN [1, 2] WHEN 4 THEN [1] WHEN 5 THEN [1, 2] WHEN 6 THEN [1] WHEN 7 THEN [1, 2] WHEN 9 THEN [1] WHEN 10 THEN [1, 2] ELSE [] END, 1) AS pos FROM r),
    f AS (SELECT workspace_id, repo_id, no, pos, path, package FROM x QUALIFY row_number() OVER (PARTITION BY repo_id, lower(package) ORDER BY no, pos) = 1),"""
_LAST = """ c AS (SELECT repo_id, no, sum(count(*)) OVER (PARTITION BY repo_id ORDER BY no) AS held FROM f GROUP BY repo_id, no),
    l AS (SELECT repo_id, min(no) AS last FROM c WHERE held > {most} GROUP BY repo_id), s AS (SELECT r.* FROM r LEFT JOIN l USING (repo_id) WHERE last IS NULL OR no <= last),"""
#: set: whatever the kind; new: of an unknown one; more: of a library.
_FOLD = """ k AS (
        SELECT workspace_id, repo_id, list_reduce(list_concat(['unknown'], list(CASE v WHEN 0 THEN 'set mobile' WHEN 2 THEN 'new frontend' WHEN 3 THEN 'new backend' WHEN 4 THEN 'set backend'
            WHEN 5 THEN 'new library' WHEN 6 THEN 'new worker' WHEN 7 THEN 'hosting' WHEN 10 THEN 'new library' ELSE '' END ORDER BY no)),
            lambda h, x: CASE WHEN x LIKE 'set %' THEN substr(x, 5) WHEN h = 'unknown' AND x LIKE 'new %' THEN substr(x, 5) WHEN x = 'hosting' AND h = 'unknown' THEN 'worker'
                WHEN x = 'hosting' AND h = 'library' THEN 'backend' ELSE h END) AS kind,
            first(CASE WHEN v IN (0, 2, 3) THEN 'n' || k WHEN v BETWEEN 4 AND 8 THEN 'P' || k WHEN v = 9 THEN 'Directory.Packages' ELSE 'tool' || k END ORDER BY no) FILTER (v NOT IN (1, 11)) AS name,
            first(CASE WHEN v < 4 THEN 'javascript' WHEN v < 10 THEN 'csharp' ELSE 'python' END ORDER BY no) FILTER (v <> 11) AS language FROM s GROUP BY ALL)
    SELECT workspace_id, repo_id, coalesce(name, repo_id) AS name, kind, coalesce(language, 'unknown') AS language FROM k"""


@query(_READ.format(files=7) + " z AS (SELECT 1) SELECT workspace_id, repo_id, string_agg(path, ',' ORDER BY no) AS paths FROM r GROUP BY ALL")
def s7_first_manifests(spark, sf_dir):
    """The first seven manifests of a repository, by kind and path."""
    read = M.read_manifests(files(spark, sf_dir), 7)
    rows = read.groupBy("workspace_id", "repo_id").agg(F.array_sort(F.collect_list(F.struct(M.manifest_rank(F.col("path")).alias("rank"), "path"))).alias("l"))
    return rows.select("workspace_id", "repo_id", csv("l.path").alias("paths"))


@query(_READ.format(files=200) + _NAMES + " z AS (SELECT 1) SELECT workspace_id, repo_id, path, package FROM f QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY no, pos) <= 500")
def c14_packages_in_order(spark, sf_dir):
    return M.manifest_packages(facts(spark, sf_dir))


@query(_READ.format(files=200) + _NAMES + " z AS (SELECT 1) SELECT workspace_id, repo_id, path, package FROM f QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY no, pos) <= 4")
def c14_first_packages(spark, sf_dir):
    """Four packages of a repository at most, as five hundred are in real use."""
    return M.manifest_packages(facts(spark, sf_dir), 4)


@query(_READ.format(files=200) + _NAMES + _LAST.format(most=500) + _FOLD)
def c15_fold_manifests(spark, sf_dir):
    return M.manifest_summary(facts(spark, sf_dir))


@query(_READ.format(files=200) + _NAMES + _LAST.format(most=4) + _FOLD)
def c15_fold_first_packages(spark, sf_dir):
    """The fold, ended by the manifest after which there are more than four packages."""
    return M.manifest_summary(facts(spark, sf_dir), 4)

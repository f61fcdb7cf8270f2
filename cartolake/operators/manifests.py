"""Manifests of a repository, folded in the order in which they are read: package.json, project files, central package lists,
pyproject files, each by path. A manifest sees the name, kind and language that those before it have settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolake.functions.exprs import blank, file_name, file_stem
from cartolake.functions.project_xml import xml_references

#: Folders whose manifests are not read, in any case of letters.
SKIPPED_DIRS = "node_modules .git bin obj dist build .next out .venv venv __pycache__".split()
#: Parts of package names that mean a frontend.
FRONTEND_HINTS = ["react", "next", "vue", "@angular/core", "svelte"]
KEY = ["workspace_id", "repo_id"]
_NONE = "array<string>"


def manifest_rank(path: Column) -> Column:
    """0 package.json, 1 a .csproj file, 2 Directory.Packages.props, 3 pyproject.toml, in any case of letters; else null."""
    base = F.lower(file_name(path))
    return F.when(base == "package.json", 0).when(base.endswith(".csproj"), 1).when(base == "directory.packages.props", 2).when(base == "pyproject.toml", 3)


def read_manifests(files: DataFrame, most: int = 200, skipped: list[str] | None = None) -> DataFrame:
    """Manifest files outside ``skipped`` folders, a repository's first ``most`` by kind and path."""
    inside = F.slice(F.split(F.lower("path"), "/"), 1, F.size(F.split("path", "/")) - 1)
    barred = F.arrays_overlap(inside, F.array(*map(F.lit, skipped or SKIPPED_DIRS)))
    rows = files.withColumn("__rank", manifest_rank(F.col("path"))).where(F.col("__rank").isNotNull() & ~barred)
    w = Window.partitionBy(*KEY).orderBy("__rank", "path")
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r", "__rank")


def _starts(name: Column, prefix: str) -> Column:
    return F.lower(name).startswith(prefix.lower())


def _python(text: Column) -> tuple[Column, Column]:
    """The first name that a pyproject text gives, and all that it depends on, line by line; comments are left out."""
    lines = F.transform(F.split(text, "\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    lines = F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
    named = F.filter(lines, lambda x: _starts(x, "name") & x.contains("="))
    values = F.transform(named, lambda x: F.regexp_replace(F.regexp_replace(x, "^[^=]*=", ""), r"(?U)^\s+|\s+$", ""))
    values = F.transform(values, lambda x: F.regexp_replace(x, "^[\"']+|[\"']+$", ""))
    depends = F.transform(lines, lambda x: F.regexp_extract(x, r"^([A-Za-z0-9_\-.\[\]]+)\s*[~=<>!]", 1))
    return F.get(F.filter(values, lambda x: x != ""), F.lit(0)), F.filter(depends, lambda x: x != "")


def manifest_facts(manifests: DataFrame) -> DataFrame:
    """What each manifest (workspace_id, repo_id, path, text) says by itself: no (its place in its repository), name, language,
    packages (in order), and what it does to the kind: kind_set, kind_new (of an unknown one), kind_more (of a library).

    A package.json that is no JSON object says nothing; a project file that is no XML has a name and a language only; other
    files are left out. A text that is null cannot be read."""
    rank = manifest_rank(F.col("path"))
    node, project, python = F.col("rank") == 0, F.col("rank").isin(1, 2), F.col("rank") == 3
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("rank", "path"))
    rows = manifests.select(*KEY, "path", "text", rank.alias("rank")).where("rank is not null")
    rows = rows.withColumn("x", xml_references(F.when(project, F.col("text"))))
    whole = F.get_json_object("text", "$")
    has = node & F.ltrim(whole).startswith("{")
    json = F.from_json("text", "name variant, scripts variant")
    text_of = lambda v, at: F.when(F.schema_of_variant(F.try_variant_get(v, at, "variant")) == "STRING", F.try_variant_get(v, at, "string"))
    keys = lambda name: F.coalesce(F.json_object_keys(F.get_json_object("text", f"$.{name}")), F.array().cast(_NONE))
    py_name, py_packages = _python(F.col("text"))
    stem = file_stem(F.col("path"))
    rows = rows.select(
        *KEY, "path", "rank", has.alias("has"), (project & F.col("x.valid")).alias("xml"), (python & F.col("text").isNotNull()).alias("py"),
        F.when(has, text_of(json["name"], "$")).when(project & ~blank(stem) & (F.lower(stem) != "directory"), stem).when(python, py_name).alias("name"),
        F.when(has, "javascript").when(project, "csharp").when(python, "python").alias("language"),
        F.when(has, keys("dependencies")).alias("depends"), F.lower("x.sdk").alias("sdk"),
        F.coalesce(F.lower(F.when(has, text_of(json["scripts"], "$.start"))).contains("node "), F.lit(False)).alias("starts"),
        F.when(has, F.concat(keys("dependencies"), keys("devDependencies"), keys("peerDependencies"))).when(project, F.col("x.packages")).when(python, py_packages).alias("packages"),
    )
    low = F.transform("depends", F.lower)
    hinted = F.exists(low, lambda d: F.array_contains(F.transform(F.array(*map(F.lit, FRONTEND_HINTS)), lambda h: d.contains(h)), True))
    web = lambda p: _starts(p, "Microsoft.AspNetCore")
    work = lambda p: _starts(p, "Microsoft.Extensions.Hosting") | _starts(p, "Hangfire")
    first = F.get(F.filter("packages", lambda p: web(p) | work(p)), F.lit(0))
    library = F.col("xml") & (F.col("sdk") != "")
    aspnet = F.exists("packages", web)
    return rows.select(
        *KEY, "path", place.alias("no"), "name", "language", F.coalesce("packages", F.array().cast(_NONE)).alias("packages"),
        F.when(F.array_contains(low, "react-native"), "mobile").when(F.col("xml") & F.col("sdk").contains("web"), "backend").when(F.col("xml") & F.col("sdk").contains("worker"), "worker").alias("kind_set"),
        F.when(F.col("has") & hinted, "frontend").when(F.col("starts"), "backend").when(library & aspnet, "backend").when(library | F.col("py"), "library")
        .when(F.col("xml") & web(first), "backend").when(F.col("xml") & first.isNotNull(), "worker").alias("kind_new"),
        F.when(F.col("xml") & aspnet, "backend").alias("kind_more"),
    )


def _firsts(facts: DataFrame) -> DataFrame:
    """(workspace_id, repo_id, no, pos, path, package): the first mention of each package in a repository, ignoring case."""
    rows = facts.select(*KEY, "no", "path", F.posexplode("packages").alias("pos", "package")).where(~blank(F.col("package")))
    return rows.groupBy(*KEY, F.lower("package").alias("k")).agg(F.min(F.struct("no", "pos", "path", "package")).alias("first")).select(*KEY, "first.*")


def _last_read(firsts: DataFrame, most: int) -> DataFrame:
    """(workspace_id, repo_id, last): the manifest after which a repository has more than ``most`` packages; no more are read."""
    counts = firsts.groupBy(*KEY, "no").agg(F.count(F.lit(1)).alias("n"))
    held = counts.withColumn("held", F.sum("n").over(Window.partitionBy(*KEY).orderBy("no")))
    return held.where(F.col("held") > most).groupBy(*KEY).agg(F.min("no").alias("last"))


def manifest_packages(facts: DataFrame, most: int = 500) -> DataFrame:
    """(workspace_id, repo_id, path, package): packages in the order of their first mention, ``most`` of a repository."""
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("no", "pos"))
    return _firsts(facts).withColumn("place", place).where(F.col("place") <= most).select(*KEY, "path", "package")


def manifest_summary(facts: DataFrame, most: int = 500) -> DataFrame:
    """(workspace_id, repo_id, name, kind, language): a fold over a repository's manifests, up to the one after which it has
    more than ``most`` packages. The name is the repository's id where none or an empty one is given."""
    read = facts.join(_last_read(_firsts(facts), most), KEY, "left").where(F.col("last").isNull() | (F.col("no") <= F.col("last")))
    # ``read_manifests`` bounds the manifests of a repository.
    ordered = read.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("no", "name", "language", "kind_set", "kind_new", "kind_more"))).alias("said"))
    start = F.struct(F.lit(None).cast("string").alias("name"), F.lit("unknown").alias("kind"), F.lit("unknown").alias("language"))

    def step(held: Column, x: Column) -> Column:
        unknown = held["kind"] == "unknown"
        kind = F.coalesce(x["kind_set"], F.when(unknown, x["kind_new"]).when(held["kind"] == "library", x["kind_more"]), held["kind"])
        language = F.when(held["language"] == "unknown", F.coalesce(x["language"], held["language"])).otherwise(held["language"])
        return F.struct(F.coalesce(held["name"], x["name"]).alias("name"), kind.alias("kind"), language.alias("language"))

    out = ordered.select(*KEY, F.aggregate("said", start, step).alias("out"))
    return out.select(*KEY, F.coalesce(F.nullif("out.name", F.lit("")), "repo_id").alias("name"), "out.kind", "out.language")

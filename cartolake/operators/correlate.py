"""Correlation of files' facts within and across repositories. Lists keep an explicit order (file path) and a bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolake.functions.exprs import blank, file_stem, normalise_path, normalised_name
from cartolake.operators import manifests
from cartolake.operators.project import facts, node_id, service_name
from cartolake.sources.scratch import stored

#: Endings that mark a use case, in their order of trial, with kinds.
CAPABILITY_SUFFIXES = {
    "CommandHandler": "command-handler", "QueryHandler": "query-handler", "EventHandler": "event-handler",
    "UseCase": "use-case", "Handler": "handler", "Command": "command", "Query": "query",
}
#: Package roots that are public, whatever their count.
PUBLIC_ROOTS = """
Microsoft System Newtonsoft Serilog AutoMapper Hangfire MediatR FluentValidation Polly OpenTelemetry Azure Google Amazon
AWSSDK Stripe Twilio Npgsql EntityFramework xunit Moq NUnit Castle MongoDB Confluent RabbitMQ MassTransit StackExchange Dapper
""".split()
STRUCTURAL_RELATIONS = ["imports", "import", "calls", "depends_on", "uses"]


def first_of(rows: DataFrame, key: list[str], column: str, n: int, name: str, repeats: bool = True) -> DataFrame:
    """(key, name): the first ``n`` distinct values of each key. Ranks are cut before values are brought together, so no
    group is larger than ``n`` of each task. Without ``repeats`` values hardly occur twice, as paths of files: ranks are then cut
    before rows are dealt out, and copies go afterwards."""
    w = Window.partitionBy(*key).orderBy(column)
    if repeats:
        first = rows.select(*key, column).distinct().withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    else:
        first = rows.select(*key, column).withColumn("__r", F.dense_rank().over(w)).where(F.col("__r") <= n).select(*key, column).distinct()
    return first.groupBy(*key).agg(F.array_sort(F.collect_list(column)).alias(name))


def summarize_services(parsed: DataFrame) -> DataFrame:
    """(workspace_id, repo_id, service, file_count, files, convention_hashes): at most five files and ten hashes."""
    c = F.col("c")
    digest = F.sha2(F.concat_ws("|", F.coalesce(c["category"], F.lit("")), F.coalesce(c["name"], F.lit("")), F.coalesce(c["description"], F.lit(""))), 256)
    rows = parsed.withColumn("service", service_name()).where(F.col("service").isNotNull())
    key = ["workspace_id", "repo_id", "service"]
    # One pass gives files and digests: a file counts at its first convention, or without any.
    listed = rows.select(*key, F.posexplode_outer("rec.conventions.conventions").alias("at", "c")).groupBy(*key, "c").agg(F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("files"), F.count("at").alias("listed"))
    listed = stored(listed.select(*key, "files", F.when(F.col("listed") > 0, digest).alias("h")), "services")
    counts = listed.groupBy(*key).agg(F.sum("files").alias("file_count")).join(first_of(rows, key, "file_path", 5, "files", repeats=False), key)
    hashes = first_of(listed.where("h is not null"), key, "h", 10, "convention_hashes")
    return counts.join(hashes, key, "left").withColumn("convention_hashes", F.coalesce("convention_hashes", F.array().cast("array<string>")))


def event_mentions(parsed: DataFrame) -> DataFrame:
    """(workspace_id, repo_id, service, file_path, event, direction) in one pass."""
    tag = lambda items, d: F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda n: F.struct(n.alias("event"), F.lit(d).alias("direction")))
    both = F.concat(tag(F.col("rec.eventsPublished.publishes.name"), "publish"), tag(F.col("rec.eventsConsumed.consumes.name"), "consume"))
    rows = parsed.select("workspace_id", "repo_id", service_name().alias("service"), "file_path", F.explode(both).alias("x"))
    return rows.select("workspace_id", "repo_id", "service", "file_path", "x.*").where(~blank(F.col("event")))


def summarize_events(parsed: DataFrame) -> DataFrame:
    """(workspace_id, repo_id, event, directions, files): directions as publish before consume."""
    key, m = ["workspace_id", "repo_id", "event"], event_mentions(parsed)
    return m.groupBy(*key).agg(F.sort_array(F.collect_set("direction"), asc=False).alias("directions")).join(first_of(m, key, "file_path", 5, "files", repeats=False), key)


def summarize_storages(parsed: DataFrame) -> DataFrame:
    """(workspace_id, repo_id, name, type, access, file_count, files); parts that are null count as empty."""
    none = lambda c: F.coalesce(c, F.lit(""))
    rows = parsed.select("workspace_id", "repo_id", "file_path", F.explode("rec.storage.storages").alias("s")).select("workspace_id", "repo_id", "file_path", none("s.name").alias("name"), none("s.type").alias("type"), none("s.access").alias("access"))
    key = ["workspace_id", "repo_id", "name", "type", "access"]
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("file_count")).join(first_of(rows, key, "file_path", 5, "files", repeats=False), key)


def summary_hash(summary: DataFrame) -> DataFrame:
    return summary.withColumn("summary_hash", F.sha2(F.to_json(F.struct(*summary.columns)), 256))


def file_service_map(listed: DataFrame, parsed: DataFrame) -> DataFrame:
    """(workspace_id, repo_id, file_path, service): files listed by a service (the last by ``ord`` wins) come before what
    files say themselves; names become their canonical form by name or alias, ignoring case.

    ``listed``: workspace_id, repo_id, ord, name, aliases, source_files.
    """
    key = ["workspace_id", "repo_id"]
    stated = listed.select(*key, "ord", "name", F.explode("source_files").alias("f")).select(*key, normalise_path(F.col("f")).alias("file_path"), F.col("name").alias("raw"), F.lit(0).alias("rank"), F.col("ord"))
    own = parsed.withColumn("raw", service_name()).where(F.col("raw").isNotNull()).select(*key, normalise_path(F.col("file_path")).alias("file_path"), "raw", F.lit(1).alias("rank"), F.lit(0).alias("ord"))
    w = Window.partitionBy(*key, "file_path").orderBy("rank", F.desc("ord"), "raw")
    best = stated.unionByName(own).withColumn("r", F.row_number().over(w)).where("r = 1")
    names = listed.select(*key, F.col("name").alias("canonical"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("a"))
    names = names.groupBy(*key, F.lower("a").alias("a")).agg(F.min("canonical").alias("canonical"))
    return best.withColumn("a", F.lower("raw")).join(names, [*key, "a"], "left").select(*key, "file_path", F.coalesce("canonical", "raw").alias("service"))


def synthesise_service(mapped: DataFrame, manifests: DataFrame, parsed: DataFrame) -> DataFrame:
    """The map, with all files of repositories that have none given to their manifest's name (workspace_id, repo_id, name)."""
    key = ["workspace_id", "repo_id"]
    bare = manifests.join(mapped.select(key).distinct(), key, "left_anti").select(*key, F.col("name").alias("service"))
    return mapped.unionByName(parsed.select(*key, normalise_path(F.col("file_path")).alias("file_path")).join(bare, key))


def resolve_owner(files: DataFrame, mapped: DataFrame, raw: bool = False) -> DataFrame:
    """(workspace_id, repo_id, file_path, service, tier): the owner of every file of ``files``, null if there is none.

    Tiers: the same path; the longest path that ends in the other, at a segment (with ``raw`` at any character) and
    ignoring case; most leading directories in common; the repository's only service. The theta joins are equi-joins on exploded suffixes and
    ancestor directories; all candidates meet in one aggregation that takes the first tier's best.
    """
    key = ["workspace_id", "repo_id"]
    full = [*key, "file_path"]
    todo = files.select(*key, "file_path", F.lower(normalise_path(F.col("file_path"))).alias("p")).distinct()
    known = mapped.select(*key, F.lower(normalise_path(F.col("file_path"))).alias("m"), "service").distinct()
    parts = lambda c: F.split(c, "/")
    any_suffix = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(c, i, F.length(c)))
    suffixes = any_suffix if raw else lambda c: F.transform(F.sequence(F.lit(1), F.size(parts(c))), lambda i: F.array_join(F.slice(parts(c), i, F.size(parts(c))), "/"))

    def parents(c: Column) -> Column:
        dirs = F.slice(parts(c), 1, F.size(parts(c)) - 1)
        return F.when(F.size(dirs) > 0, F.transform(F.sequence(F.lit(1), F.size(dirs)), lambda i: F.array_join(F.slice(dirs, 1, i), "/")))

    def tier(rows: DataFrame, number: int, score: Column) -> DataFrame:
        return rows.select(*full, F.struct(F.lit(number).alias("tier"), (-score).cast("int").alias("s"), "service").alias("b"))

    theirs = known.withColumn("d", F.explode(parents(F.col("m")))).groupBy(*key, "d").agg(F.min("service").alias("service"))  # one service stands for a directory
    only = known.groupBy(*key).agg(F.min("service").alias("service"), F.count_distinct(F.lower("service")).alias("n")).where("n = 1")
    found = tier(todo.join(known.withColumnRenamed("m", "p"), [*key, "p"]), 1, F.lit(0))
    found = found.union(tier(todo.withColumn("m", F.explode(suffixes(F.col("p")))).join(known, [*key, "m"]), 2, F.length("m")))
    found = found.union(tier(known.withColumn("p", F.explode(suffixes(F.col("m")))).join(todo, [*key, "p"]), 2, F.length("m")))
    found = found.union(tier(todo.withColumn("d", F.explode(parents(F.col("p")))).join(theirs, [*key, "d"]), 3, F.size(parts(F.col("d")))))
    found = found.union(tier(todo.join(only, key), 4, F.lit(0)))
    best = found.groupBy(*full).agg(F.min("b").alias("b"))
    return todo.join(best, full, "left").select(*full, F.col("b.service").alias("service"), F.coalesce("b.tier", F.lit(0)).alias("tier"))


def capability_from_path(path: Column) -> Column:
    """struct(name, kind): the file stem without the first of the endings that it has; null if it has none."""
    stem = file_stem(path)
    cases = [F.when(stem.endswith(s) & (F.length(stem) > len(s)), F.struct(F.substring(stem, F.lit(1), F.length(stem) - len(s)).alias("name"), F.lit(k).alias("kind"))) for s, k in CAPABILITY_SUFFIXES.items()]
    return F.coalesce(*cases)


def capabilities(files: DataFrame) -> DataFrame:
    return files.withColumn("c", capability_from_path(F.col("file_path"))).where("c is not null").select("workspace_id", "repo_id", "file_path", "c.name", "c.kind")


def stitch_edges(parsed: DataFrame, owners: DataFrame) -> DataFrame:
    """Facts of files that name no service, with edges from the file's owner; of several owners the first by name."""
    key = ["workspace_id", "repo_id", "file_path"]
    one = owners.groupBy(*key).agg(F.min("service").alias("__owner"))
    nameless = parsed.where(service_name().isNull()).join(one, key, "left")
    return facts(nameless, owner=F.col("__owner"))


def stitch_counts(emitted: DataFrame) -> DataFrame:
    """(edge, stitched, unmatched) per kind of edge."""
    e = emitted.where("x.edge is not null")
    return e.groupBy("x.edge").agg(F.count_if(F.col("service_name").isNotNull()).alias("stitched"), F.count_if(F.col("service_name").isNull()).alias("unmatched"))


def service_depends_on(gnodes: DataFrame, gedges: DataFrame, mapped: DataFrame) -> DataFrame:
    """(workspace_id, source, target): services one of whose files imports, calls or uses a file of another."""
    of = gnodes.select("repo_id", "id", normalise_path(F.col("source_file")).alias("file_path")).join(mapped, ["repo_id", "file_path"]).select("workspace_id", "repo_id", "id", "service")
    e = gedges.where(F.lower("label").isin(STRUCTURAL_RELATIONS)).select("repo_id", "source_id", "target_id")
    e = e.join(of.withColumnsRenamed({"id": "source_id", "service": "source"}), ["repo_id", "source_id"])
    e = e.join(of.withColumnsRenamed({"id": "target_id", "service": "target"}), ["workspace_id", "repo_id", "target_id"])
    return e.where("source <> target").select("workspace_id", "source", "target").distinct()


def manifest_packages(files: DataFrame, most: int = 500) -> DataFrame:
    """(workspace_id, repo_id, path, package): names that package.json, project files and pyproject files depend on, once
    per repository ignoring case, the first ``most``."""
    return manifests.manifest_packages(manifests.manifest_facts(files), most)


def classify_repo_kind(files: DataFrame, most: int = 500) -> DataFrame:
    """(workspace_id, repo_id, kind): mobile, frontend, backend, worker, library or unknown, by a fold over the manifests."""
    return manifests.manifest_summary(manifests.manifest_facts(files), most).select("workspace_id", "repo_id", "kind")


def classify_internal(packages: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(workspace_id, repo_id, package, internal): scopes or dotted roots on two packages or more, without public roots, and
    the repository's own root (``names``: workspace_id, repo_id, name)."""
    key = ["workspace_id", "repo_id"]
    scoped = F.col("package").startswith("@") & F.col("package").contains("/")
    root = F.when(scoped, F.lower(F.substring_index("package", "/", 1))).when(F.col("package").contains("."), F.lower(F.substring_index("package", ".", 1)))
    rows = packages.select(*key, "package").distinct().withColumn("root", root)
    public = F.col("root").isin([r.lower() for r in PUBLIC_ROOTS])
    many = rows.where(F.col("root").isNotNull() & ~public).groupBy(*key, "root").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(*key, "root")
    if names is not None:
        many = many.union(names.select(*key, F.lower(F.substring_index("name", ".", 1)).alias("root"))).distinct()
    out = rows.join(many.withColumn("internal", F.lit(True)), [*key, "root"], "left")
    return out.select(*key, "package", F.coalesce("internal", F.lit(False)).alias("internal"))


def repo_name_language(files: DataFrame, most: int = 500) -> DataFrame:
    """(workspace_id, repo_id, name, language) by the first manifest that gives one; the repository's id if none has a name."""
    return manifests.manifest_summary(manifests.manifest_facts(files), most).select("workspace_id", "repo_id", "name", "language")


def package_classes(packages: DataFrame) -> DataFrame:
    """(workspace_id, package, repo_id, internal, members): the repositories that share a package, ignoring case, one row for each.

    This is the whole relation in as many rows as there are members; pairs are expanded from it for what is asked.
    """
    p = packages.select("workspace_id", F.lower("package").alias("package"), "repo_id", "internal").groupBy("workspace_id", "package", "repo_id").agg(F.bool_or("internal").alias("internal"))
    sizes = p.groupBy("workspace_id", "package").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return p.join(sizes, ["workspace_id", "package"])


def shared_packages(packages: DataFrame, services: DataFrame, most: int = 20, asked: DataFrame | None = None) -> DataFrame:
    """(workspace_id, source, target, signal, shared): services of two repositories with packages in common, ignoring case.

    Internal packages come first (signal 'internal'); pairs without any share all packages, of which ``most`` are listed
    ('transitive'). ``packages`` has ``internal``. With ``asked`` (workspace_id, repo_id) only pairs that have one of these
    repositories are expanded. Internal packages meet by themselves first, and what they link is left out before the lists of
    all packages are gathered; every other pair that is formed is a pair of the result.
    """
    p = package_classes(packages).select("workspace_id", "repo_id", F.col("package").alias("k"), "internal")
    own = p if asked is None else p.join(asked.select("workspace_id", "repo_id").distinct(), ["workspace_id", "repo_id"], "left_semi")
    a, b = own.toDF("workspace_id", "ra", "k", "ia"), p.toDF("workspace_id", "rb", "k", "ib")
    pair = ["workspace_id", "ra", "rb"]
    # An asked repository meets those on both sides of it; pairs of two asked ones come twice, and are one.
    other = F.col("ra") < F.col("rb") if asked is None else F.col("ra") != F.col("rb")
    ordered = lambda rows: rows.where(other).select("workspace_id", F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb"), "k")
    once = (lambda rows: rows) if asked is None else (lambda rows: rows.distinct())
    gather = lambda rows: rows.groupBy(*pair).agg(F.array_sort(F.collect_list("k")).alias("shared"))
    inner = gather(once(ordered(a.where("ia").join(b.where("ib"), ["workspace_id", "k"]))))
    rest = gather(once(ordered(a.join(b, ["workspace_id", "k"]))).join(inner.select(pair), pair, "left_anti"))
    pairs = inner.select(*pair, F.lit("internal").alias("signal"), "shared").union(rest.select(*pair, F.lit("transitive"), F.slice("shared", 1, most)))
    s = services.select("workspace_id", "repo_id", "service").distinct()
    out = pairs.join(s.toDF("workspace_id", "ra", "source"), ["workspace_id", "ra"]).join(s.toDF("workspace_id", "rb", "target"), ["workspace_id", "rb"])
    return out.where("source <> target").select("workspace_id", "source", "target", "signal", "shared")


def workspace_summary(parsed: DataFrame, most: int = 20) -> DataFrame:
    """(workspace_id, repo_id, service, endpoints, published, consumed): at most ``most`` endpoints by text order."""
    rows = parsed.withColumn("service", service_name()).where("service is not null")
    key, none = ["workspace_id", "repo_id", "service"], F.array().cast("array<string>")
    tagged = lambda items, kind: F.transform(F.coalesce(items, none), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("v")))
    routes = F.transform("rec.endpoints.endpoints", lambda e: F.concat_ws(" ", e["method"], e["path"]))
    all_ = F.concat(tagged(routes, "e"), tagged(F.col("rec.eventsPublished.publishes.name"), "p"), tagged(F.col("rec.eventsConsumed.consumes.name"), "c"))
    x = rows.select(*key, F.explode_outer(all_).alias("x")).select(*key, "x.*")
    listed = first_of(x.where("kind = 'e' and v is not null"), key, "v", most, "endpoints")
    part = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("v"))))
    named = x.groupBy(*key).agg(part("p").alias("published"), part("c").alias("consumed"))  # the names themselves are the result
    return named.join(listed, key, "left").select(*key, F.coalesce("endpoints", none).alias("endpoints"), "published", "consumed")


def eligible_for_cross_repo(parsed: DataFrame) -> DataFrame:
    """(workspace_id, repos, services, eligible): two repositories or more, and a service."""
    out = parsed.groupBy("workspace_id").agg(F.count_distinct("repo_id").alias("repos"), F.count_distinct(service_name()).alias("services"))
    return out.withColumn("eligible", (F.col("repos") >= 2) & (F.col("services") >= 1))


def _edges(rows: DataFrame, label: Column, source: Column, target: Column, **props: Column) -> DataFrame:
    pairs = F.create_map(*[x for k, v in props.items() for x in (F.lit(k), v.cast("string"))]).cast("map<string,string>") if props else F.create_map().cast("map<string,string>")
    return rows.select("workspace_id", label.alias("label"), source.alias("source_id"), target.alias("target_id"), pairs.alias("props"))


def apply_services(found: DataFrame) -> DataFrame:
    """Node rows of named services (workspace_id, name, purpose)."""
    props = F.create_map(F.lit("name"), F.col("name"), F.lit("workspace_id"), F.col("workspace_id"), F.lit("purpose"), F.col("purpose"))
    return found.where(~blank(F.col("name"))).select("workspace_id", F.lit("Service").alias("label"), node_id("Service", F.col("name")).alias("id"), "name", F.map_filter(props, lambda k, v: v.isNotNull()).alias("props"))


def apply_event_topology(found: DataFrame) -> DataFrame:
    """Edges of (workspace_id, event, publishers, consumers)."""
    tag = lambda c, label: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda s: F.struct(s.alias("service"), F.lit(label).alias("label")))
    rows = found.select("workspace_id", "event", F.explode(F.concat(tag(F.col("publishers"), "PUBLISHES"), tag(F.col("consumers"), "CONSUMES"))).alias("x")).distinct()
    return _edges(rows, F.col("x.label"), node_id("Service", F.col("x.service")), node_id("Event", F.col("event"), F.lit("")))


def apply_conventions(found: DataFrame) -> DataFrame:
    """Edges of (workspace_id, category, name, followed_by)."""
    rows = found.select("workspace_id", "category", "name", F.explode("followed_by").alias("service"))
    return _edges(rows, F.lit("FOLLOWS"), node_id("Service", F.col("service")), node_id("Convention", F.col("category"), F.col("name")))


def apply_calls(calls: DataFrame) -> DataFrame:
    """CALLS edges between services of (workspace_id, caller, callee, evidence)."""
    return _edges(calls, F.lit("CALLS"), node_id("Service", F.col("caller")), node_id("Service", F.col("callee")), evidence=F.col("evidence"), inferred_by=F.lit("cross-repo"))


def majority_conventions(parsed: DataFrame, ratio: float = 0.5) -> DataFrame:
    """(workspace_id, repo_id, category, name, followers, services): conventions that enough of the services follow."""
    rows = parsed.withColumn("service", service_name()).where("service is not null")
    key = ["workspace_id", "repo_id"]
    total = rows.groupBy(*key).agg(F.count_distinct("service").alias("services"))
    own = rows.select(*key, "service", F.explode("rec.conventions.conventions").alias("c")).groupBy(*key, F.col("c.category").alias("category"), F.col("c.name").alias("name")).agg(F.count_distinct("service").alias("followers"))
    return own.join(total, key).where(F.col("followers") >= ratio * F.col("services"))


def one_sided_events(parsed: DataFrame) -> DataFrame:
    """(workspace_id, repo_id, event, missing_side): events that no other repository consumes, or publishes."""
    m = event_mentions(parsed).select("workspace_id", "repo_id", "event", "direction").distinct()
    # The least and the greatest repository of either side tell whether another one is there.
    side = lambda d: F.when(F.col("direction") == d, F.col("repo_id"))
    per = m.groupBy("workspace_id", "event").agg(*[f(side(d)).alias(f"{n}_{d}") for d in ("publish", "consume") for n, f in (("lo", F.min), ("hi", F.max))])
    out = m.join(per, ["workspace_id", "event"])
    publishes = F.col("direction") == "publish"
    other = lambda end: F.when(publishes, F.col(f"{end}_consume")).otherwise(F.col(f"{end}_publish")) == F.col("repo_id")
    alone = F.coalesce(other("lo") & other("hi"), F.lit(True))  # nobody, or only the repository itself
    return out.where(alone).select("workspace_id", "repo_id", "event", F.when(publishes, "consumer").otherwise("publisher").alias("missing_side"))


def direction_conflicts(parsed: DataFrame) -> DataFrame:
    """(workspace_id, event, patterns): events that repositories use in different sets of directions."""
    per = event_mentions(parsed).groupBy("workspace_id", "event", "repo_id").agg(F.array_join(F.sort_array(F.collect_set("direction")), "+").alias("pattern"))
    out = per.groupBy("workspace_id", "event").agg(F.array_sort(F.collect_set("pattern")).alias("patterns"))
    return out.where(F.size("patterns") > 1)


def merge_services(parsed: DataFrame, files: int = 50) -> DataFrame:
    """(workspace_id, key, canonical, aliases, file_count, source_files): services whose names agree in letters and digits, with
    their first ``files`` files by path."""
    key = ["workspace_id", "key"]
    rows = parsed.withColumn("service", service_name()).where("service is not null").select("workspace_id", normalised_name(F.col("service")).alias("key"), "service", "file_path")
    out = rows.groupBy(*key).agg(F.min("service").alias("canonical"), F.array_sort(F.collect_set("service")).alias("aliases"), F.count(F.lit(1)).alias("file_count"))
    return out.join(first_of(rows, key, "file_path", files, "source_files", repeats=False), key)


def record_conflicts(conflicts: DataFrame) -> DataFrame:
    """Rows to append: kind and description cut, involved as JSON, status open."""
    return conflicts.select(
        "workspace_id", "repo_id", F.substring("kind", 1, 50).alias("kind"), F.substring("description", 1, 2000).alias("description"),
        F.to_json("involved").alias("involved"), F.lit("open").alias("status"),
    )

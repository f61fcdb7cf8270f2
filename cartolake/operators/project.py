"""Facts of files projected into graph nodes and edges with content-derived ids.

Input rows (parsed extractions): workspace_id, repo_id, file_path, content_hash, rec (struct of schemas.RECORD). Every
projector returns emitted facts ``x``: a node, and an edge from the file's service to it where the file names a service.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.functions.exprs import blank, deterministic_guid, first_non_blank, normalise_http_path
from cartolake.schemas import RECORD

_PROPS = "map<string,string>"
_FACT = f"struct<label:string,id:string,name:string,props:{_PROPS},edge:string,edge_props:{_PROPS}>"


def parse_extractions(files: DataFrame) -> DataFrame:
    """``extraction_payload`` as ``rec``; keys in camel or Pascal case; malformed payloads are skipped.

    Each payload is parsed once, in the case of its section names; only one that mixes both is parsed in both. The result
    goes through a generator, so that the check on malformed ones does not parse again.
    """
    schema = f"struct<{RECORD}, _corrupt_record string>"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    text = F.col("extraction_payload")
    camel, pascal = F.from_json(text, schema, options), F.from_json(text, _pascal(schema), options).cast(schema)
    has = lambda names: text.rlike('"(?:' + "|".join(names) + r')"\s*:')
    upper = has([n[0].upper() + n[1:] for n in _sections()])
    c, p = F.col("r.c"), F.col("r.p")
    both = F.struct(F.when(~upper | has(_sections()), camel).alias("c"), F.when(upper, pascal).alias("p"))
    out = files.where(text.isNotNull()).select("*", F.explode(F.array(both)).alias("r"))
    out = out.where(F.coalesce(c["_corrupt_record"], p["_corrupt_record"]).isNull())
    return out.withColumn("rec", F.struct(*[F.coalesce(c[n], p[n]).alias(n) for n in _sections()])).drop("r")


def _sections() -> list[str]:
    return ["service", "endpoints", "eventsPublished", "eventsConsumed", "storage", "conventions", "integrationContracts"]


def _pascal(schema: str) -> str:
    """The same schema with field names in Pascal case."""
    return re.sub(r"\b([a-z])(\w*)(?=\s+(?:struct|array|string|boolean))", lambda m: m[1].upper() + m[2], schema)


def service_name() -> Column:
    """The service that the file belongs to, or null."""
    named = F.col("rec.service.isPartOfService") & ~blank(F.col("rec.service.serviceName"))
    return F.when(named, F.col("rec.service.serviceName"))


def service_key(name: Column) -> Column:
    return F.concat(F.lit("Service|"), F.col("workspace_id"), F.lit("|"), name)


def service_id(name: Column) -> Column:
    return deterministic_guid(service_key(name))


def node_key(label: str, *parts: Column) -> Column:
    """Label, tenant and key parts in one text; null parts count as empty."""
    return F.concat_ws("|", F.lit(label), F.col("workspace_id"), *[F.coalesce(p, F.lit("")) for p in parts])


def node_id(label: str, *parts: Column) -> Column:
    """GUID of a node's key."""
    return deterministic_guid(node_key(label, *parts))


def _props(**values: Column) -> Column:
    pairs = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(pairs, lambda k, v: v.isNotNull()).cast(_PROPS)


def _fact(label: Column | str, id_: Column, name: Column, props: Column, edge: Column | str, edge_props: Column | None = None) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        text(label).alias("label"), id_.alias("id"), name.alias("name"), props.alias("props"), text(edge).cast("string").alias("edge"),
        (edge_props if edge_props is not None else F.create_map().cast(_PROPS)).alias("edge_props"),
    ).cast(_FACT)


def _each(items: Column, keep, make) -> Column:
    none = F.array().cast(f"array<{_FACT}>")
    return F.coalesce(F.transform(F.filter(items, keep), make), none)


def services() -> Column:
    name, s = service_name(), F.col("rec.service")
    props = _props(name=name, workspace_id=F.col("workspace_id"), purpose=s["servicePurpose"], root_path=s["rootPath"], tech_stack=F.array_join(s["techStack"], ","))
    one = F.array(_fact("Service", service_key(name), name, props, F.lit(None)))
    return F.when(name.isNotNull(), one).otherwise(F.array().cast(f"array<{_FACT}>"))


def _endpoint(method: Column, path: Column, edge: str, edge_props: Column | None = None) -> Column:
    props = _props(method=method, path=path, workspace_id=F.col("workspace_id"))
    return _fact("Endpoint", node_key("Endpoint", method, path), F.concat_ws(" ", method, path), props, edge, edge_props)


def endpoints(normalise: bool = False) -> Column:
    """Verbatim method and path; with ``normalise`` as the calling side writes them."""
    m = lambda e: F.upper(F.trim(e["method"])) if normalise else e["method"]
    p = lambda e: normalise_http_path(e["path"]) if normalise else e["path"]
    return _each(F.col("rec.endpoints.endpoints"), lambda e: ~blank(e["method"]) & ~blank(e["path"]), lambda e: _endpoint(m(e), p(e), "EXPOSES"))


def _event(e: Column, edge: str) -> Column:
    props = _props(name=e["name"], workspace_id=F.col("workspace_id"), version=e["version"], payload_summary=e["schemaSummary"], topic=e["topic"])
    return _fact("Event", node_key("Event", e["name"], e["version"]), e["name"], props, edge)


def events_published() -> Column:
    return _each(F.col("rec.eventsPublished.publishes"), lambda e: ~blank(e["name"]), lambda e: _event(e, "PUBLISHES"))


def events_consumed() -> Column:
    return _each(F.col("rec.eventsConsumed.consumes"), lambda e: ~blank(e["name"]), lambda e: _event(e, "CONSUMES"))


def storage() -> Column:
    def one(s: Column) -> Column:
        props = _props(name=s["name"], workspace_id=F.col("workspace_id"), kind=s["type"], connection_hint=s["connectionHint"])
        return _fact("Storage", node_key("Storage", s["name"]), s["name"], props, F.when(F.lower(s["access"]) == "owns", "WRITES_TO").otherwise("READS_FROM"))

    return _each(F.col("rec.storage.storages"), lambda s: ~blank(s["name"]), one)


def conventions() -> Column:
    def one(c: Column) -> Column:
        props = _props(name=c["name"], workspace_id=F.col("workspace_id"), category=c["category"], description=c["description"])
        return _fact("Convention", node_key("Convention", c["category"], c["name"]), c["name"], props, "FOLLOWS")

    return _each(F.col("rec.conventions.conventions"), lambda c: ~blank(c["name"]) & ~blank(c["category"]), one)


def http_calls() -> Column:
    def one(c: Column) -> Column:
        return _endpoint(F.upper(F.trim(c["method"])), normalise_http_path(c["path"]), "CALLS", _props(transport=F.lit("http"), base_url=c["baseUrl"], evidence=c["evidence"]))

    return _each(F.col("rec.integrationContracts.httpClientCalls"), lambda c: ~blank(c["method"]) & ~blank(c["path"]), one)


def _remote(field: str, kind: str, edge: str, transport: bool) -> Column:
    def one(c: Column) -> Column:
        extra = {"transport": F.lit(kind)} if transport else {}
        return _endpoint(F.lit(kind), F.concat_ws(".", c["service"], c["method"]), edge, _props(**extra, evidence=c["evidence"]))

    return _each(F.col(f"rec.integrationContracts.{field}"), lambda c: ~blank(c["service"]) & ~blank(c["method"]), one)


def grpc_calls() -> Column:
    return _remote("grpcClientCalls", "grpc", "CALLS", True)


def grpc_servers() -> Column:
    return _remote("grpcServerImpls", "grpc", "EXPOSES", False)


def signalr_hubs() -> Column:
    return _remote("signalRHubMethods", "signalr", "EXPOSES", False)


def signalr_invokes() -> Column:
    return _remote("signalRClientInvokes", "signalr", "CALLS", True)


def resolve_messaging_node(m: Column) -> Column:
    """struct(label, name): a Queue where a queue is set or the kind is one of rabbit or sqs, else an Event; null name if
    all parts are blank."""
    name = first_non_blank(m["topic"], m["exchange"], m["queue"], m["messageType"], m["routingKey"])
    queue = ~blank(m["queue"]) | F.coalesce(F.lower(m["kind"]).rlike("rabbit|sqs"), F.lit(False))
    return F.struct(F.when(queue, "Queue").otherwise("Event").alias("label"), name.alias("name"))


def _messages(field: str, edge: str) -> Column:
    def one(m: Column) -> Column:
        node = resolve_messaging_node(m)
        key = F.concat(node["label"], F.lit("|"), F.col("workspace_id"), F.lit("|"), node["name"], F.lit("|"))
        props = _props(name=node["name"], workspace_id=F.col("workspace_id"), kind=m["kind"])
        return _fact(node["label"], key, node["name"], props, edge, _props(transport=m["kind"], routing_key=m["routingKey"]))

    return _each(F.col(f"rec.integrationContracts.{field}"), lambda m: resolve_messaging_node(m)["name"].isNotNull(), one)


def msg_publishes() -> Column:
    return _messages("messagingPublishes", "PUBLISHES")


def msg_consumes() -> Column:
    return _messages("messagingConsumes", "CONSUMES")


PROJECTORS = {
    "services": services, "endpoints": endpoints, "events_published": events_published, "events_consumed": events_consumed,
    "storage": storage, "conventions": conventions, "http_calls": http_calls, "grpc_calls": grpc_calls, "grpc_servers": grpc_servers,
    "signalr_hubs": signalr_hubs, "signalr_invokes": signalr_invokes, "msg_publishes": msg_publishes, "msg_consumes": msg_consumes,
}


#: The sections that give edges of each label.
EDGE_SECTIONS = {
    "EXPOSES": ["endpoints", "grpc_servers", "signalr_hubs"], "CALLS": ["http_calls", "grpc_calls", "signalr_invokes"],
    "PUBLISHES": ["events_published", "msg_publishes"], "CONSUMES": ["events_consumed", "msg_consumes"],
    "WRITES_TO": ["storage"], "READS_FROM": ["storage"], "FOLLOWS": ["conventions"],
}


def _all(names: list[str] | None) -> Column:
    return F.concat(*[PROJECTORS[n]() for n in names or PROJECTORS])


def _extraction() -> Column:
    return deterministic_guid(F.concat_ws(":", "file_path", "content_hash"))


def facts(parsed: DataFrame, names: list[str] | None = None, owner: Column | None = None) -> DataFrame:
    """One row per emitted fact: a single pass over the extractions with one explode for all sections.

    Projectors give a fact's key, which becomes its GUID after the explode. ``owner``: the service that edges start from;
    by default the one that the file itself names. ``created_at`` of the extractions is carried on, if they have it.
    """
    source = owner if owner is not None else service_name()
    from_ = F.when(source.isNotNull(), service_id(source))
    # One step per file for what its facts share, and one per fact.
    files = parsed.select("*", _extraction().alias("__extraction"), F.explode(F.array(F.struct(source.alias("name"), from_.alias("id")))).alias("__s"))
    rows = files.select("workspace_id", "repo_id", "file_path", *_time(parsed), F.col("__extraction").alias("extraction_id"), F.col("__s.name").alias("service_name"), F.col("__s.id").alias("service_id"), F.explode(_all(names)).alias("x"))
    return rows.withColumn("x", F.col("x").withField("id", deterministic_guid(F.col("x.id"))))


#: Where the items of a section lie in a record, with their fields.
ITEMS = {
    "endpoints": ("endpoints", "endpoints", ["method", "path"]),
    "events_published": ("eventsPublished", "publishes", ["name", "version", "schemaSummary", "topic"]),
    "events_consumed": ("eventsConsumed", "consumes", ["name", "version", "schemaSummary", "topic"]),
    "storage": ("storage", "storages", ["name", "type", "access", "connectionHint"]),
    "conventions": ("conventions", "conventions", ["category", "name", "description"]),
    "http_calls": ("integrationContracts", "httpClientCalls", ["method", "path"]),
    "grpc_calls": ("integrationContracts", "grpcClientCalls", ["service", "method"]),
    "grpc_servers": ("integrationContracts", "grpcServerImpls", ["service", "method"]),
    "signalr_hubs": ("integrationContracts", "signalRHubMethods", ["service", "method"]),
    "signalr_invokes": ("integrationContracts", "signalRClientInvokes", ["service", "method"]),
    "msg_publishes": ("integrationContracts", "messagingPublishes", ["kind", "exchange", "routingKey", "topic", "queue", "messageType"]),
    "msg_consumes": ("integrationContracts", "messagingConsumes", ["kind", "exchange", "routingKey", "topic", "queue", "messageType"]),
}
_FIELDS = 6


def distinct_items(parsed: DataFrame) -> DataFrame:
    """Records of one item each, or of a service by itself, for all different items of a tenant as far as nodes come from them: ``rec``
    with the last origin (time, extraction, file, repository) and the number of items that it stands for (``items``).

    Items are one where they are parsed, before they are projected or dealt out. ``sections`` makes the engine hash its groups: an
    origin alone would have it sort all items.
    """
    void = F.lit(None).cast("string")
    pad = lambda values: [v.cast("string").alias(f"f{i}") for i, v in enumerate([*values, *[void] * (_FIELDS - len(values))])]
    none = F.array().cast("array<struct<section:string," + ",".join(f"f{i}:string" for i in range(_FIELDS)) + ">>")
    one = lambda name, values: F.struct(F.lit(name).alias("section"), *pad(values))
    s = F.col("rec.service")
    own = F.when(service_name().isNotNull(), F.array(one("services", [service_name(), s["servicePurpose"], s["rootPath"], F.array_join(s["techStack"], ",")])))
    each = lambda name, outer, inner, fields: F.transform(F.col(f"rec.{outer}.{inner}"), lambda e: one(name, [e[f] for f in fields]))
    lists = [each(name, *place) for name, place in ITEMS.items()]
    files = parsed.select("*", F.explode(F.array(_extraction())).alias("__extraction"))
    rows = files.select("workspace_id", "repo_id", "file_path", *_time(parsed), "__extraction", F.explode(F.concat(*[F.coalesce(x, none) for x in [own, *lists]])).alias("i"))
    origin = F.max(F.struct(*_time(parsed), F.col("__extraction").alias("last_extraction_id"), "file_path", "repo_id"))
    once = rows.groupBy("workspace_id", "i").agg(origin.alias("o"), F.count(F.lit(1)).alias("items"), F.collect_set("i.section").alias("sections"))
    types, at = parsed.schema["rec"].dataType, lambda name: F.col("i.section") == name

    def section(field: str) -> Column:
        """The record's field, with the item in its list."""
        if field == "service":
            tech = F.when(F.col("i.f3") != "", F.array("i.f3")).otherwise(F.when(F.col("i.f3").isNotNull(), F.array().cast("array<string>")))
            made = {"isPartOfService": F.lit(True), "serviceName": F.col("i.f0"), "servicePurpose": F.col("i.f1"), "rootPath": F.col("i.f2"), "techStack": tech}
            return F.when(at("services"), F.struct(*[v.alias(k) for k, v in made.items()]).cast(types[field].dataType)).alias(field)
        parts = []
        for f in types[field].dataType:
            name = next((n for n, (outer, inner, _) in ITEMS.items() if (outer, inner) == (field, f.name)), None)
            if name is None:
                parts.append(F.lit(None).cast(f.dataType).alias(f.name))
                continue
            places = {k: f"i.f{i}" for i, k in enumerate(ITEMS[name][2])}
            made = F.struct(*[(F.col(places[g.name]) if g.name in places else void).alias(g.name) for g in f.dataType.elementType])
            parts.append(F.when(at(name), F.array(made)).cast(f.dataType).alias(f.name))
        return F.struct(*parts).alias(field)

    return once.select("workspace_id", *[F.col(f"o.{c}").alias(c) for c in ["repo_id", "file_path", "last_extraction_id", *_time(parsed)]], F.struct(*map(section, _sections())).alias("rec"), "items", "sections")


def distinct_node_rows(items: DataFrame) -> DataFrame:
    """``node_rows`` of the facts of ``distinct_items``, with the number of facts that each stands for (``specs``). Merged, they give what all
    files' rows give."""
    rows = items.select("workspace_id", "repo_id", "file_path", "last_extraction_id", *_time(items), F.col("items").alias("specs"), F.explode(_all(None)).alias("x"))
    return rows.select("workspace_id", "x.label", deterministic_guid(F.col("x.id")).alias("id"), "x.name", "x.props", "repo_id", "file_path", "last_extraction_id", *_time(items), "specs")


def first_edges(parsed: DataFrame, now: Column, labels: list[str] | None = None) -> DataFrame:
    """What ``upsert_edges`` makes of all facts, their own nodes and an empty table, dealt out once; with ``labels`` only edges of these,
    for which only the sections are projected that have some.

    A file's edges to one target are brought together before they are dealt out, so that is a row for each pair of ends that a task
    meets; GUIDs come last. Both ends are nodes of the same facts, so none is missing.
    """
    names = None if labels is None else [n for n in PROJECTORS if any(n in EDGE_SECTIONS.get(label, []) for label in labels)]
    name, key, time = service_name(), ["workspace_id", "service_name", "target"], _time(parsed)
    files = parsed.where(name.isNotNull()).select("workspace_id", *time, name.alias("service_name"), F.explode(F.array(_all(names))).alias("xs"))
    files = files.withColumn("xs", F.filter("xs", lambda x: x["edge"].isNotNull() if labels is None else x["edge"].isin(labels)))
    pairs = files.select("*", F.explode(F.array_distinct(F.transform("xs", lambda x: x["id"]))).alias("target"))
    own = F.transform(F.filter("xs", lambda x: x["id"] == F.col("target")), lambda x: F.struct(x["edge"].alias("label"), F.map_entries(x["edge_props"]).alias("props")))
    met = pairs.select(*key, F.struct(*time, F.array_distinct(own).alias("edges")).alias("s")).groupBy(*key).agg(F.collect_set("s").alias("specs"))
    label = F.explode(F.array_distinct(F.flatten(F.transform("specs", lambda s: s["edges"]["label"])))).alias("label")
    at = lambda s: [s[c] for c in time]
    mine = lambda s: F.flatten(F.transform(F.filter(s["edges"], lambda e: e["label"] == F.col("label")), lambda e: F.transform(e["props"], lambda p: F.struct(p["key"].alias("k"), *at(s), p["value"].alias("v")))))
    rows = met.select(*key, "specs", label).withColumn("values", F.array_sort(F.flatten(F.transform("specs", mine))))
    last = F.filter("values", lambda p, i: F.coalesce(F.get("values", i + 1)["k"] != p["k"], F.lit(True)))
    props = F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))
    return rows.select(
        "workspace_id", "label", service_id(F.col("service_name")).alias("source_id"), deterministic_guid(F.col("target")).alias("target_id"), props.alias("props"), now.alias("updated_at")
    )


def node_rows(emitted: DataFrame) -> DataFrame:
    """Node specs, one per emission (not yet merged)."""
    return emitted.select(
        "workspace_id", "x.label", "x.id", "x.name", "x.props", "repo_id", "file_path", F.col("extraction_id").alias("last_extraction_id"), *_time(emitted)
    )


def _time(df: DataFrame) -> list[str]:
    """``created_at``, where the extractions have it."""
    return [c for c in ["created_at"] if c in df.columns]


def edge_rows(emitted: DataFrame) -> DataFrame:
    """Edge specs of facts whose file has a service."""
    rows = emitted.where(F.col("x.edge").isNotNull() & F.col("service_id").isNotNull())
    return rows.select("workspace_id", F.col("x.edge").alias("label"), F.col("service_id").alias("source_id"), F.col("x.id").alias("target_id"), F.col("x.edge_props").alias("props"), *_time(emitted))


def project_all(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node specs, edge specs) of all sections."""
    emitted = facts(parsed)
    return node_rows(emitted), edge_rows(emitted)

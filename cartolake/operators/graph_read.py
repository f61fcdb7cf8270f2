"""Graph reads as joins over ``nodes`` and ``edges``. Every read is per tenant, and both ends of an edge are checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolake.schemas import EDGE_LABELS, NODE_LABELS, node_labels
from cartolake.sources.scratch import stored


def _in(df: DataFrame, ws: str | None) -> DataFrame:
    return df if ws is None else df.where(F.col("workspace_id") == ws)


def _nodes(nodes: DataFrame, label: str, ws: str | None = None, name: str | None = None) -> DataFrame:
    out = _in(nodes, ws).where(F.col("label") == label)
    return out if name is None else out.where(F.col("name") == name)


def prop(key: str, of: str = "props") -> Column:
    return F.element_at(of, F.lit(key))


def hop(sources: DataFrame, edges: DataFrame, targets: DataFrame, labels: list[str]) -> DataFrame:
    """Edges of the given labels between two node sets, as structs s, e and t; filters reach the scans below the joins."""
    e = edges.where(F.col("label").isin(labels)).select("workspace_id", "source_id", "target_id", F.struct("label", "props").alias("e"))
    s = sources.select("workspace_id", F.col("id").alias("source_id"), F.struct("id", "label", "name", "props").alias("s"))
    t = targets.select("workspace_id", F.col("id").alias("target_id"), F.struct("id", "label", "name", "props").alias("t"))
    return e.join(s, ["workspace_id", "source_id"]).join(t, ["workspace_id", "target_id"])


def get_service(nodes: DataFrame, ws: str, name: str) -> DataFrame:
    return _nodes(nodes, "Service", ws, name).orderBy("id").limit(1)


def list_services(nodes: DataFrame, ws: str | None = None) -> DataFrame:
    return _nodes(nodes, "Service", ws).orderBy("workspace_id", "name")


def service_endpoints(nodes: DataFrame, edges: DataFrame, ws: str | None = None, name: str | None = None) -> DataFrame:
    """(workspace_id, service, id, method, path), by path and method."""
    rows = hop(_nodes(nodes, "Service", ws, name), edges, _nodes(nodes, "Endpoint", ws), ["EXPOSES"])
    return rows.select("workspace_id", F.col("s.name").alias("service"), "t.id", prop("method", "t.props").alias("method"), prop("path", "t.props").alias("path")).orderBy("path", "method")


def event_services(nodes: DataFrame, edges: DataFrame, label: str, ws: str | None = None, event: str | None = None) -> DataFrame:
    """(workspace_id, event, service): services that publish (PUBLISHES) or consume (CONSUMES) an event, by name."""
    rows = hop(_nodes(nodes, "Service", ws), edges, _nodes(nodes, "Event", ws, event), [label])
    return rows.select("workspace_id", F.col("t.name").alias("event"), F.col("s.name").alias("service")).distinct().orderBy("event", "service")


def topology(nodes: DataFrame, edges: DataFrame, ws: str | None = None) -> DataFrame:
    """(workspace_id, service, direction, event) of services and the events they publish or consume."""
    rows = hop(_nodes(nodes, "Service", ws), edges, _nodes(nodes, "Event", ws), ["PUBLISHES", "CONSUMES"])
    return rows.select("workspace_id", F.col("s.name").alias("service"), F.col("e.label").alias("direction"), F.col("t.name").alias("event")).distinct()


def linked_services(publishers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(workspace_id, a, id_a, b, id_b): each service a (workspace_id, event, a, id_a) with every other b (workspace_id, event, b, id_b) that
    consumes one of the events that a publishes, once.

    Services with the same events are a class. Classes meet by events, and a pair of services is formed once, from its classes.
    """

    def classes(rows: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
        c = f"class_{side}"
        own = rows.groupBy("workspace_id", side, f"id_{side}").agg(F.array_sort(F.collect_set("event")).alias("events")).withColumn(c, F.sha2(F.to_json("events"), 256))
        return own.drop("events"), own.select("workspace_id", c, "events").distinct().select("workspace_id", c, F.explode("events").alias("event"))

    (own_a, events_a), (own_b, events_b) = classes(publishers, "a"), classes(consumers, "b")
    met = events_a.join(events_b, ["workspace_id", "event"]).select("workspace_id", "class_a", "class_b").distinct()
    return own_a.join(met, ["workspace_id", "class_a"]).join(own_b, ["workspace_id", "class_b"]).where("a <> b").select("workspace_id", "a", "id_a", "b", "id_b")


def service_dependencies(nodes: DataFrame, edges: DataFrame, ws: str | None = None, name: str | None = None, label: str = "Service") -> DataFrame:
    rows = hop(_nodes(nodes, "Service", ws, name), edges, _nodes(nodes, label, ws), ["DEPENDS_ON"])
    return rows.select("workspace_id", F.col("s.name").alias("service"), F.col("t.name").alias("dependency")).distinct().orderBy("service", "dependency")


def conventions(nodes: DataFrame, ws: str | None = None, category: str | None = None) -> DataFrame:
    rows = _nodes(nodes, "Convention", ws).withColumn("category", prop("category"))
    return (rows if category is None else rows.where(F.col("category") == category)).orderBy("category", "name")


def nodes_by_label(nodes: DataFrame, ws: str, label: str, limit: int = 200) -> DataFrame:
    """(id, name) by id; the limit is held in 1..5000; unknown labels are refused."""
    if label not in NODE_LABELS:
        raise ValueError(f"unknown label {label}")
    return _nodes(nodes, label, ws).select("id", "name").orderBy("id").limit(min(5000, max(1, limit)))


def node_detail(nodes: DataFrame, edges: DataFrame, ws: str, label: str, id_: str) -> DataFrame:
    """One row: the node, with incoming and outgoing edges and their other ends."""
    me = _nodes(nodes, label, ws).where(F.col("id") == id_)
    others, own = _in(nodes, ws), _in(edges, ws)
    both = []
    for mine, other, side in (("target_id", "source_id", "incoming"), ("source_id", "target_id", "outgoing")):
        e = own.where(F.col(mine) == id_).select(F.col(other).alias("id"), F.col("label").alias("edge"), F.col("props").alias("edge_props"))
        rows = e.join(others.select("id", "label", "name"), "id")
        both.append(rows.agg(F.array_sort(F.collect_list(F.struct("edge", "label", "name", "id"))).alias(side)))
    return me.crossJoin(both[0]).crossJoin(both[1])  # one row each


def _counts(found: DataFrame, kind: str, labels: list[str], per: list[str]) -> DataFrame:
    spark = found.sparkSession
    n = found.groupBy(*per, "label").agg(F.count(F.lit(1)).alias("n"))
    all_ = spark.createDataFrame([(x,) for x in labels], "label string").coalesce(1)
    keys = found.select(*per).distinct().crossJoin(F.broadcast(all_)) if per else all_  # labels are a fixed short list
    return keys.join(n, [*per, "label"], "left").select(*per, F.lit(kind).alias("kind"), "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def count_nodes_per_label(nodes: DataFrame, ws: str | None = None) -> DataFrame:
    """(workspace_id, kind, label, n) for every known label, zeros too."""
    return _counts(_in(nodes, ws).where(F.col("label").isin(list(NODE_LABELS))), "node", list(NODE_LABELS), ["workspace_id"])


def count_edges_per_label(nodes: DataFrame, edges: DataFrame, ws: str | None = None) -> DataFrame:
    """The same for edges whose ends are both in the tenant. Ends that are not are sought among the distinct ones and written, so edges are
    dealt out only if there are many such ends."""
    own = _in(edges, ws).where("workspace_id is not null and source_id is not null and target_id is not null")
    ends = own.select("workspace_id", F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    missing = stored(ends.join(_in(nodes, ws).select("workspace_id", "id"), ["workspace_id", "id"], "left_anti"), "missing")
    e = own.join(missing.withColumnRenamed("id", "source_id"), ["workspace_id", "source_id"], "left_anti")
    e = e.join(missing.withColumnRenamed("id", "target_id"), ["workspace_id", "target_id"], "left_anti")
    return _counts(e, "edge", list(EDGE_LABELS), ["workspace_id"])


def overview(nodes: DataFrame, edges: DataFrame, ws: str | None = None) -> DataFrame:
    return count_nodes_per_label(nodes, ws).unionByName(count_edges_per_label(nodes, edges, ws))


def service_neighborhood(nodes: DataFrame, edges: DataFrame, ws: str | None = None, name: str | None = None) -> DataFrame:
    """One row per service with sorted endpoints, dependencies, publishes and consumes (empty where there are none)."""
    services = _nodes(nodes, "Service", ws, name)
    rows = hop(services, edges, _in(nodes, ws), ["EXPOSES", "DEPENDS_ON", "PUBLISHES", "CONSUMES"])
    part = lambda label: F.array_sort(F.collect_set(F.when(F.col("e.label") == label, F.col("t.name"))))
    own = rows.groupBy("workspace_id", "source_id").agg(part("EXPOSES").alias("endpoints"), part("DEPENDS_ON").alias("dependencies"), part("PUBLISHES").alias("publishes"), part("CONSUMES").alias("consumes"))
    none = F.array().cast("array<string>")
    out = services.select("workspace_id", F.col("id").alias("source_id"), "name").join(own, ["workspace_id", "source_id"], "left")
    return out.select("workspace_id", "name", *[F.coalesce(c, none).alias(c) for c in ("endpoints", "dependencies", "publishes", "consumes")])


def list_endpoints(nodes: DataFrame, edges: DataFrame, ws: str | None = None, service: str | None = None, method: str | None = None) -> DataFrame:
    """Distinct (service, method, path); a service is met by its name, a dotted child of it, or any name that it begins."""
    s = _nodes(nodes, "Service", ws)
    if service is not None:
        s = s.where((F.col("name") == service) | F.col("name").startswith(f"{service}.") | F.lit(service).startswith(F.col("name")))
    rows = hop(s, edges, _nodes(nodes, "Endpoint", ws), ["EXPOSES"])
    out = rows.select("workspace_id", F.col("s.name").alias("service"), prop("method", "t.props").alias("method"), prop("path", "t.props").alias("path"))
    out = out if method is None else out.where(F.lower("method") == method.lower())
    return out.distinct().orderBy("path", "method")


def aliases(services: DataFrame, asked: DataFrame) -> DataFrame:
    """(workspace_id, asked, name): for each of the ``asked`` names (workspace_id, name) the ``services`` (the same columns) that it
    means: its own name, a dotted child of it, or any name that it begins with.

    Both ways are equi-joins: an asked name is cut at the lengths that service names of its tenant have (as many as the longest
    name has characters, at most), and a service name at its dots.
    """
    known = services.select("workspace_id", "name").where("name is not null").distinct()
    want = asked.select("workspace_id", F.col("name").alias("asked")).where("asked is not null").distinct()
    lengths = known.groupBy("workspace_id").agg(F.array_sort(F.collect_set(F.length("name"))).alias("lengths"))
    cut = want.join(lengths, "workspace_id").select("workspace_id", "asked", F.explode(F.filter("lengths", lambda n: n <= F.length("asked"))).alias("n"))
    begun = cut.withColumn("name", F.substring("asked", F.lit(1), F.col("n"))).join(known, ["workspace_id", "name"]).select("workspace_id", "asked", "name")
    parts = F.split("name", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    below = known.where(F.col("name").contains(".")).select("workspace_id", "name", F.explode(above).alias("asked")).join(want, ["workspace_id", "asked"]).select("workspace_id", "asked", "name")
    return begun.union(below).distinct()


def endpoints_of(nodes: DataFrame, edges: DataFrame, asked: DataFrame, ws: str | None = None, method: str | None = None) -> DataFrame:
    """(workspace_id, asked, method, path): the distinct endpoints of every asked service name (workspace_id, name), by ``aliases``.
    The method's case does not matter."""
    s = _nodes(nodes, "Service", ws)
    rows = hop(s, edges, _nodes(nodes, "Endpoint", ws), ["EXPOSES"]).select("workspace_id", F.col("s.name").alias("name"), prop("method", "t.props").alias("method"), prop("path", "t.props").alias("path"))
    rows = rows if method is None else rows.where(F.lower("method") == method.lower())
    return rows.distinct().join(aliases(s, asked), ["workspace_id", "name"]).select("workspace_id", "asked", "method", "path").distinct()


def callers_by_id(nodes: DataFrame, edges: DataFrame, ws: str | None, endpoint_id: str) -> DataFrame:
    return _callers(nodes, edges, ws, _nodes(nodes, "Endpoint", ws).where(F.col("id") == endpoint_id))


def callers_by_route(nodes: DataFrame, edges: DataFrame, ws: str | None, method: str | None = None, path: str | None = None) -> DataFrame:
    """Callers of endpoints; the method's case does not matter, the path's does. None stands for any."""
    e = _nodes(nodes, "Endpoint", ws)
    e = e if method is None else e.where(F.lower(prop("method")) == method.lower())
    return _callers(nodes, edges, ws, e if path is None else e.where(prop("path") == path))


def _callers(nodes: DataFrame, edges: DataFrame, ws: str | None, targets: DataFrame) -> DataFrame:
    rows = hop(_in(nodes, ws), edges, targets, ["CALLS"])
    return rows.select("workspace_id", F.col("s.label").alias("caller_label"), F.col("s.name").alias("caller"), prop("method", "t.props").alias("method"), prop("path", "t.props").alias("path")).distinct()


def search_nodes(nodes: DataFrame, tokens: list[str], limit: int = 25, ws: str | None = None) -> DataFrame:
    """Nodes whose name or description has a token, ignoring case; labels in schema order, at most max(5, limit) of one
    label and ``limit`` (1..500) in all, per tenant; ties by id."""
    limit, wanted = min(500, max(1, limit)), sorted({t.strip().lower() for t in tokens} - {""})
    found = F.lit(False)
    for t in wanted:
        found = found | F.lower(F.coalesce("name", F.lit(""))).contains(t) | F.lower(F.coalesce(prop("description"), F.lit(""))).contains(t)
    rows = _in(nodes, ws).where(found & F.col("id").isNotNull()).join(F.broadcast(node_labels(nodes.sparkSession)), "label")  # ten rows
    in_label = Window.partitionBy("workspace_id", "label_rank").orderBy("id")
    in_all = Window.partitionBy("workspace_id").orderBy("label_rank", "id")
    rows = rows.withColumn("r", F.row_number().over(in_label)).where(F.col("r") <= max(5, limit))
    return rows.withColumn("r", F.row_number().over(in_all)).where(F.col("r") <= limit).select("workspace_id", "label", "id", "name")


def visualization(nodes: DataFrame, edges: DataFrame, node_limit: int = 500, ws: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, truncated): per tenant, nodes label by label up to the limit (1..2000), and at most three times as
    many edges among them; ``truncated`` tells whether the limit was reached."""
    node_limit = min(2000, max(1, node_limit))
    ranked = _in(nodes, ws).join(F.broadcast(node_labels(nodes.sparkSession)), "label")  # ten rows
    w = Window.partitionBy("workspace_id").orderBy("label_rank", "id")
    top = ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= node_limit)
    ids = top.select("workspace_id", "id")
    inner = _in(edges, ws).join(ids.withColumnRenamed("id", "source_id"), ["workspace_id", "source_id"], "left_semi")
    inner = inner.join(ids.withColumnRenamed("id", "target_id"), ["workspace_id", "target_id"], "left_semi")
    ew = Window.partitionBy("workspace_id").orderBy("source_id", "label", "target_id")
    inner = inner.withColumn("r", F.row_number().over(ew)).where(F.col("r") <= 3 * node_limit).select("workspace_id", "label", "source_id", "target_id")
    cut = top.groupBy("workspace_id").agg((F.count(F.lit(1)) >= node_limit).alias("truncated"))
    return top.select("workspace_id", "label", "id", "name"), inner, cut


def callers_of_service(nodes: DataFrame, edges: DataFrame, ws: str | None = None) -> DataFrame:
    """(workspace_id, callee, caller): who calls an endpoint that the callee exposes."""
    services, ends = _nodes(nodes, "Service", ws), _nodes(nodes, "Endpoint", ws)
    calls = hop(services, edges, ends, ["CALLS"]).select("workspace_id", "target_id", F.col("s.name").alias("caller"))
    exposes = hop(services, edges, ends, ["EXPOSES"]).select("workspace_id", "target_id", F.col("s.name").alias("callee"))
    return calls.join(exposes, ["workspace_id", "target_id"]).select("workspace_id", "callee", "caller").distinct()


def legend_counts(nodes: DataFrame) -> DataFrame:
    """(kind, key, n): nodes per label and per repository."""
    pairs = F.explode(F.array(F.struct(F.lit("label").alias("kind"), F.col("label").alias("key")), F.struct(F.lit("repo").alias("kind"), F.col("repo_id").alias("key"))))
    return nodes.select(pairs.alias("p")).groupBy("p.kind", "p.key").agg(F.count(F.lit(1)).alias("n"))


def degree(edges: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """(id, degree, size): both ends count; size is 4 to 12 by share of the largest degree."""
    ends = edges.select(F.explode(F.array(source, target)).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    most = ends.agg(F.max("degree").alias("most"))
    sized = ends.crossJoin(F.broadcast(most))  # one row
    return sized.select("id", "degree", (4 + F.round(F.col("degree") / F.col("most") * 8)).cast("long").alias("size"))


def neighborhood(edges: DataFrame, id_: object, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """Edges among a node and its direct neighbours."""
    near = edges.where((F.col(source) == id_) | (F.col(target) == id_)).select(F.explode(F.array(source, target)).alias("n")).union(edges.sparkSession.createDataFrame([(id_,)], f"n {edges.schema[source].dataType.simpleString()}")).distinct()
    out = edges.join(near.withColumnRenamed("n", source), source, "left_semi")
    return out.join(near.withColumnRenamed("n", target), target, "left_semi")


def filter_names(nodes: DataFrame, needle: str) -> DataFrame:
    """Nodes whose name (else id) or label has the needle, ignoring case."""
    n = needle.lower()
    return nodes.where(F.lower(F.coalesce("name", "id")).contains(n) | F.lower("label").contains(n))

"""Schemas of the tables, and the declared graph schema as small frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NODES = "workspace_id string, label string, id string, name string, props map<string,string>, repo_id string, file_path string, last_extraction_id string, updated_at timestamp"
EDGES = "workspace_id string, label string, source_id string, target_id string, props map<string,string>, updated_at timestamp"

_EVENT = "array<struct<name string, version string, schemaSummary string, topic string>>"
_CALL = "array<struct<service string, method string, evidence string>>"
_MESSAGE = "array<struct<kind string, exchange string, routingKey string, topic string, queue string, messageType string>>"
#: One file's facts; JSON keys are camel case.
RECORD = (
    "service struct<isPartOfService boolean, serviceName string, servicePurpose string, rootPath string, techStack array<string>>, "
    "endpoints struct<endpoints array<struct<method string, path string, handlerSymbol string>>>, "
    f"eventsPublished struct<publishes {_EVENT}>, eventsConsumed struct<consumes {_EVENT}>, "
    "storage struct<storages array<struct<name string, type string, access string, connectionHint string>>>, "
    "conventions struct<conventions array<struct<category string, name string, description string>>>, "
    "integrationContracts struct<httpClientCalls array<struct<method string, path string, baseUrl string, evidence string>>, "
    f"grpcClientCalls {_CALL}, grpcServerImpls {_CALL}, signalRHubMethods {_CALL}, signalRClientInvokes {_CALL}, "
    f"messagingPublishes {_MESSAGE}, messagingConsumes {_MESSAGE}, sharedPackageImports array<string>>"
)

#: Node labels in their search order, with required and optional properties.
NODE_LABELS = {
    "Service": (["name", "workspace_id"], ["language", "framework", "description", "source_files"]),
    "Endpoint": (["method", "path", "workspace_id"], ["service_name", "status_codes"]),
    "Database": (["name", "workspace_id"], ["kind", "tech"]),
    "Queue": (["name", "workspace_id"], ["kind"]),
    "Event": (["name", "workspace_id"], ["payload_summary"]),
    "Concept": (["name", "workspace_id"], ["description"]),
    "File": (["path", "workspace_id"], ["language"]),
    "Convention": (["name", "workspace_id"], ["description"]),
    "Capability": (["name", "workspace_id"], ["description"]),
    "Storage": (["name", "workspace_id"], ["kind"]),
}
#: Edge labels with the labels allowed at either end.
EDGE_LABELS = {
    "CALLS": (["Service"], ["Endpoint", "Service"]),
    "EXPOSES": (["Service"], ["Endpoint"]),
    "READS_FROM": (["Service"], ["Database", "Storage"]),
    "WRITES_TO": (["Service"], ["Database", "Storage"]),
    "PUBLISHES": (["Service"], ["Event", "Queue"]),
    "CONSUMES": (["Service"], ["Event", "Queue"]),
    "DEPENDS_ON": (["Service"], ["Service"]),
    "DEFINED_IN": (["Service", "Endpoint", "Convention", "Capability"], ["File"]),
    "IMPLEMENTS": (["Service"], ["Capability"]),
    "FOLLOWS": (["Service"], ["Convention"]),
    "RELATES_TO": (["Concept"], ["Concept", "Service", "Capability"]),
    "STORES": (["Storage"], ["Concept"]),
    "CONFLICTS_WITH": (["*"], ["*"]),
    "SHARES_PACKAGE_WITH": (["Service"], ["Service"]),
}
IMPLEMENTATION_PROPERTIES = ["id", "updated_at", "created_at", "last_extraction_id", "repo_id", "file_path"]


def node_labels(spark: SparkSession) -> DataFrame:
    """(label, label_rank, required, optional): ten rows."""
    rows = [(k, i, *v) for i, (k, v) in enumerate(NODE_LABELS.items())]
    return spark.createDataFrame(rows, "label string, label_rank int, required array<string>, optional array<string>").coalesce(1)


def edge_labels(spark: SparkSession) -> DataFrame:
    """(label, from_labels, to_labels): fourteen rows."""
    return spark.createDataFrame([(k, *v) for k, v in EDGE_LABELS.items()], "label string, from_labels array<string>, to_labels array<string>").coalesce(1)

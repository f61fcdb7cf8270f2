"""Expressions on the documented edge cases."""

import uuid
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from cartolake.functions import exprs as X
from cartolake.operators import corpus, correlate, questions
from cartolake.operators.project import resolve_messaging_node


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_guid(spark):
    key = "Service|w|a"
    assert one(spark, X.deterministic_guid(F.lit(key))) == "3602606e-04ba-b2a0-5608-c1eb43625249" == str(uuid.UUID(bytes_le=md5(key.encode()).digest()))


@pytest.mark.parametrize(("raw", "want"), [("https://h.io", "/"), ("api//x?y#z", "/api/x"), (" /a#b?c ", "/a"), (None, None)])
def test_http_path(spark, raw, want):
    got = one(spark, X.normalise_http_path(F.lit(raw).cast("string")))
    assert got == want
    if want:
        assert one(spark, X.normalise_http_path(F.lit(got))) == got


def test_repo_urls(spark):
    assert tuple(one(spark, X.parse_repo_url(F.lit("git@github.com:o/r.git")))) == ("o", "r")
    assert one(spark, X.parse_repo_url(F.lit("https://gitlab.com/o/r"))) is None
    assert one(spark, X.derive_repo_name(F.lit("https://x.io/o/r.git?y=1"))) == "r"


@pytest.mark.parametrize(("path", "dropped"), [(".env/x.cs", False), (".git/x", True), ("a/.hid/b", True), (".", False)])
def test_dot_segments(spark, path, dropped):
    assert one(spark, corpus.dot_segment(F.lit(path))) is dropped


def test_trim_source(spark):
    trim = lambda t, lang: one(spark, corpus.trim_source(F.lit(t), F.lit(lang)))
    assert trim("http://a // c", "csharp") == "http://a"
    assert trim("a\n\n\n\nb", "unknown") == "a\n\nb"
    assert trim('x = 1 # y\n"""doc"""\n', "python") == "x = 1\n\n"


@pytest.mark.parametrize(
    ("message", "want"),
    [({"kind": "rabbitmq", "exchange": "e"}, ("Queue", "e")), ({"topic": "t", "kind": "kafka"}, ("Event", "t")), ({"topic": " "}, ("Event", None)), ({"queue": "q"}, ("Queue", "q"))],
)
def test_messaging(spark, message, want):
    fields = ["kind", "exchange", "routingKey", "topic", "queue", "messageType"]
    m = F.struct(*[F.lit(message.get(f)).cast("string").alias(f) for f in fields])
    got = spark.range(1).select(m.alias("m")).select(resolve_messaging_node(F.col("m")).alias("x")).first().x
    assert tuple(got) == want


@pytest.mark.parametrize(
    ("path", "want"), [("a/JoinTournamentUseCase.cs", ("JoinTournament", "use-case")), ("Handler.cs", None), ("XCommandHandler.cs", ("X", "command-handler"))]
)
def test_capability(spark, path, want):
    got = one(spark, correlate.capability_from_path(F.lit(path)))
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(
    ("severity", "files", "degree", "blocks", "source", "want"),
    [("high", 30, 100, True, "CrossFileCorrelation", 100), ("low", 0, 0, False, "x", 40), (None, 0, 0, False, "x", 60)],
)
def test_priority(spark, severity, files, degree, blocks, source, want):
    assert one(spark, questions.priority(F.lit(severity).cast("string"), F.lit(files), F.lit(degree), F.lit(blocks), F.lit(source))) == want


def test_tokens_and_estimate(spark):
    assert one(spark, X.significant_tokens(F.lit("Add the Order service, order with (Billing)"))) == ["Order", "service", "Billing"]
    assert one(spark, X.significant_tokens(F.lit(None).cast("string"))) == []
    assert one(spark, X.estimate_tokens(F.lit("12345"))) == 2
    assert one(spark, X.has_traversal(F.lit("/a/../b"))) and not one(spark, X.has_traversal(F.lit("a..b")))

"""Column expressions shared by the operators. All stay in the JVM; null in gives null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a task text.
STOP_WORDS = """
the this that these those with from into onto over under have having been being your yours their theirs what when where
while which would could should about after before between also just very much many more most some such than then they them
will shall please make made want need code file files
""".split()
TASK_SEPARATORS = r"""[ \t\n\r.,;:!?()\[\]{}"'/\\]+"""


def deterministic_guid(key: Column) -> Column:
    """MD5 of ``key`` as a GUID whose first three groups are little-endian."""
    return F.regexp_replace(F.md5(key), "^(..)(..)(..)(..)(..)(..)(..)(..)(.{4})(.{12})$", "$4$3$2$1-$6$5-$8$7-$9-$10")


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(~c.rlike(r"\S"), F.lit(True))


def first_non_blank(*columns: Column) -> Column:
    """The first column with text, trimmed; null if none."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def normalise_path(path: Column) -> Column:
    r"""``\`` becomes ``/``; leading ``/`` go."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "^/+", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def file_extension(path: Column) -> Column:
    """Lower-case extension with its dot, or empty."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))


def has_traversal(path: Column) -> Column:
    """Any ``..`` segment."""
    return F.array_contains(F.split(normalise_path(path), "/"), "..")


def normalise_http_path(url: Column) -> Column:
    """Trimmed, without query, fragment, scheme and host; one leading ``/`` and no doubled ones."""
    cut = F.substring_index(F.substring_index(F.trim(url), "?", 1), "#", 1)
    rest = F.when(cut.contains("://"), F.regexp_replace(F.regexp_replace(cut, r"^.*?://", ""), r"^[^/]*", "")).otherwise(cut)
    return F.regexp_replace(F.concat(F.lit("/"), rest), "/{2,}", "/")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4.0).cast("long")


_HTTPS = r"^https?://(?:www\.)?github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$"
_SSH = r"^git@github\.com:([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$"


def parse_repo_url(url: Column) -> Column:
    """struct(owner, name) of an https or ssh address; null if it is neither."""
    text = F.trim(url)
    form = lambda p: F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("owner"), F.regexp_extract(text, p, 2).alias("name")))
    return F.coalesce(form(_HTTPS), form(_SSH))


def derive_repo_name(url: Column) -> Column:
    """Last path segment without query and ``.git``."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), "/+$", ""), r"\.git$", "")
    return F.element_at(F.split(clean, "[/:]"), -1)


def normalised_name(name: Column) -> Column:
    """Letters and digits only, lower-case."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{Nd}]", ""))


def distinct_ci(values: Column) -> Column:
    """First-seen values, ignoring case."""
    empty = F.array().cast("array<string>")
    return F.aggregate(values, empty, lambda acc, v: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(v)), acc).otherwise(F.concat(acc, F.array(v))))


def significant_tokens(task: Column) -> Column:
    """Words of four characters or more that are no stop words, first-seen, ignoring case; empty for null."""
    words = F.split(F.coalesce(task, F.lit("")), TASK_SEPARATORS)
    keep = F.filter(words, lambda w: (F.length(w) >= 4) & ~F.lower(w).isin(STOP_WORDS))
    return distinct_ci(keep)


def fingerprint(workspace: Column, topic: Column, question: Column, files: Column, empty_marker: str = "") -> Column:
    """SHA-256 of tenant, topic, question and the sorted files; ``empty_marker`` stands for no files."""
    joined = F.array_join(F.array_sort(F.coalesce(files, F.array().cast("array<string>"))), "|")
    return F.sha2(F.concat_ws("|", F.replace(workspace, F.lit("-"), F.lit("")), topic, question, F.when(joined == "", F.lit(empty_marker)).otherwise(joined)), 256)


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)

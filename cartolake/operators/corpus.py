"""Filters over a corpus of source files, and preparation of their text (rows: path, length, content, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.functions.exprs import blank, estimate_tokens, file_extension, normalise_path

#: Directories that are skipped, whatever their case.
IGNORED_DIRS = """
.git .github .next .nuxt .venv .idea .vscode .cache .turbo .gradle .mvn .terraform node_modules bower_components vendor dist
build out target bin obj __pycache__ coverage migrations
""".split()
#: Extensions of binary files.
BINARY_EXTENSIONS = """
.png .jpg .jpeg .gif .bmp .webp .ico .svg .pdf .zip .tar .gz .tgz .bz2 .7z .rar .ttf .woff .woff2 .otf .eot .so .dll .exe
.dylib .a .lib .o .class .jar .pyc .wasm .mp3 .mp4 .mov .avi .wav .flac .db .sqlite .sqlite3
""".split()
#: Endings of generated files' names.
GENERATED_SUFFIXES = [".generated.cs", ".g.cs", ".g.i.cs", "_pb2.py", "_pb.go", ".pb.cs", ".pb.swift", ".designer.cs"]
#: What a generated file says in its first 300 characters.
GENERATED_MARKERS = [
    "// <auto-generated",
    "# this file is auto-generated",
    "// this file was generated",
    "// code generated by",
    "// do not edit",
    "/* this file was auto-generated",
    "# do not edit",
]
MAX_BYTES = 1 << 20


def _segments(path: Column) -> Column:
    return F.split(normalise_path(path), "/")


def ignored_dir(path: Column) -> Column:
    return F.arrays_overlap(F.transform(_segments(path), F.lower), F.array(*map(F.lit, IGNORED_DIRS)))


def dot_segment(path: Column) -> Column:
    """A hidden segment other than ``.env``; a lone dot is none."""
    return F.exists(_segments(path), lambda s: (F.length(s) > 1) & s.startswith(".") & (F.lower(s) != ".env"))


def binary_ext(path: Column) -> Column:
    return file_extension(path).isin(BINARY_EXTENSIONS)


def generated_name(path: Column) -> Column:
    name = F.lower(path)
    found = F.lit(False)
    for suffix in GENERATED_SUFFIXES:
        found = found | name.endswith(suffix)
    return found


def drop_ignored_dirs(files: DataFrame) -> DataFrame:
    return files.where(~ignored_dir(F.col("path")))


def drop_dot_segments(files: DataFrame) -> DataFrame:
    return files.where(~dot_segment(F.col("path")))


def drop_binary_ext(files: DataFrame) -> DataFrame:
    return files.where(~binary_ext(F.col("path")))


def drop_generated_names(files: DataFrame) -> DataFrame:
    return files.where(~generated_name(F.col("path")))


def drop_oversize(files: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    return files.where(F.col("length") <= limit)


def drop_binary_content(files: DataFrame) -> DataFrame:
    """Drops files with a zero byte among the first 8192."""
    return files.where(F.instr(F.decode(F.substring("content", 1, 8192), "ISO-8859-1"), "\0") == 0)


def drop_autogenerated(files: DataFrame) -> DataFrame:
    head = F.lower(F.substring("text", 1, 300))
    found = F.lit(False)
    for marker in GENERATED_MARKERS:
        found = found | head.contains(marker)
    return files.where(~found)


def content_hash(files: DataFrame, of: str = "text") -> DataFrame:
    """SHA-256 of the decoded text (full scans) or of the bytes (``of='content'``, change scans)."""
    return files.withColumn("content_hash", F.sha2(F.col(of), 256))


def considered_files(files: DataFrame) -> DataFrame:
    """The path filters with their verdict kept, for counting."""
    dropped = ignored_dir(F.col("path")) | dot_segment(F.col("path")) | binary_ext(F.col("path")) | generated_name(F.col("path")) | (F.col("length") > MAX_BYTES)
    return files.withColumn("kept", ~dropped)


def scan_counters(files: DataFrame) -> DataFrame:
    """(repo_id, considered, kept)."""
    return considered_files(files).groupBy("repo_id").agg(F.count(F.lit(1)).alias("considered"), F.count_if("kept").alias("kept"))


def skip_blank(files: DataFrame) -> DataFrame:
    return files.where(~blank(F.col("text")))


def detect_language(path: Column) -> Column:
    ext = file_extension(path)
    return (
        F.when(ext == ".cs", "csharp")
        .when(ext.isin(".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), "typescript")
        .when(ext == ".py", "python")
        .when(ext.isin(".java", ".kt", ".kts"), "java")
        .when(ext == ".go", "go")
        .otherwise("unknown")
    )


def trim_source(text: Column, language: Column) -> Column:
    """Text without comments, trailing blanks and runs of empty lines; unknown languages keep their comments."""
    slashes = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"(?<![:/])//[^\n\r]*", "")
    hashes = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, '(?s)""".*?"""', ""), "(?s)'''.*?'''", ""), r"#[^\n\r]*", "")
    bare = F.when(language == "python", hashes).when(language == "unknown", text).otherwise(slashes)
    return F.regexp_replace(F.regexp_replace(bare, r"(?m)[ \t]+$", ""), r"(\r?\n){3,}", "\n\n")


def prepare(files: DataFrame) -> DataFrame:
    """Adds language, trimmed text and its estimated tokens."""
    out = files.withColumn("language", detect_language(F.col("path")))
    out = out.withColumn("trimmed", trim_source(F.col("text"), F.col("language")))
    return out.withColumn("tokens", estimate_tokens(F.col("trimmed")))


def scan_filter(files: DataFrame) -> DataFrame:
    """All filters of a full scan in order; path tests come first, so they reach the scan."""
    kept = drop_oversize(drop_generated_names(drop_binary_ext(drop_dot_segments(drop_ignored_dirs(files)))))
    return drop_autogenerated(drop_binary_content(kept))

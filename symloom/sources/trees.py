"""Source trees: discovery, reading, what to skip, and compile databases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import strings as S

#: Indexed extensions, and folders that are never entered.
EXTENSIONS = ("c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx", "inl", "inc", "lua", "py", "ts", "tsx", "rs")
SKIPPED_FOLDERS = ("node_modules", "target")
#: Limits of files that are not worth parsing.
MAX_BYTES, MAX_ODD, SAMPLE, NUMERIC_LINES, MARKERS = 2 * 1024 * 1024, 128, 64 * 1024, 8, 6


def parse_extensions(raw: str | None, known: Sequence[str] = EXTENSIONS) -> tuple[str, ...]:
    """A comma-separated list; one unknown extension makes it the default list."""
    wanted = tuple(dict.fromkeys(x.strip().lower().lstrip(".") for x in (raw or "").split(",") if x.strip()))
    return wanted if wanted and all(x in known for x in wanted) else tuple(known)


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """Whether any of the regexes (one a line; # begins a comment; invalid ones do not count) is in the path."""
    import re

    valid = []
    for line in patterns:
        text = line.strip()
        if text and not text.startswith("#"):
            try:
                re.compile(text)
            except re.error:
                continue
            valid.append(text)
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return S.any_of([plain.rlike(p) for p in valid])


def discover(spark: SparkSession, root: str, ignore: Sequence[str] = (), extensions: Sequence[str] = EXTENSIONS, data_folder: str = ".symloom") -> DataFrame:
    """(path, text, content_hash, language, size): the sources below root, relative to it, undecodable bytes replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?(?=/)", ""), f"^\\Q{base}\\E/", "")
    kept = files.select(path.alias("path"), "content", F.col("length").alias("size")).where(S.extension(F.col("path")).isin(*extensions))
    kept = kept.where(~F.exists(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda f: f.startswith(".") | f.isin(*SKIPPED_FOLDERS, data_folder)))
    kept = kept.where(~ignored(F.col("path"), ignore))
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.make_valid_utf8(F.col("content").cast("string")))
    return kept.select("path", text.alias("text"), F.sha2("content", 256).alias("content_hash"), S.language(F.col("path")).alias("language"), "size")


def skip_reason(text: Column) -> Column:
    """Why a C++ file is not parsed: too_large, binary or numeric_blob; null for files with enough signs of source."""
    sample = F.substring(text, 1, SAMPLE)
    markers = F.regexp_count(sample, F.lit(r"[;{}]|#include|#define|\b(class|struct|namespace|template|return)\b"))
    odd = F.regexp_count(sample, F.lit("[\x00�]"))
    lines = F.slice(F.split(sample, "\n"), 1, 64)
    numeric = F.size(F.filter(lines, lambda x: x.rlike(r"^[\s0-9a-fA-FxX,.+-]*[0-9][\s0-9a-fA-FxX,.+-]*$") & (F.length(x) > 16)))
    reason = F.when(F.octet_length(text) > MAX_BYTES, "too_large").when(odd >= MAX_ODD, "binary").when(numeric >= NUMERIC_LINES, "numeric_blob")
    return F.when(markers < MARKERS, reason)


def compile_database(spark: SparkSession, path: str) -> DataFrame:
    """(file, directory, include_dirs, defines, output) of a compile_commands.json."""
    schema = "directory string, file string, command string, arguments array<string>, output string"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    args = F.coalesce("arguments", F.split("command", r"\s+"))
    taken = lambda flag: F.array_distinct(F.concat(F.transform(F.filter(args, lambda a: a.startswith(flag) & (F.length(a) > 2)), lambda a: F.substr(a, F.lit(3))), F.filter(F.transform(args, lambda a, i: F.when((a == flag) & (i + 1 < F.size(args)), F.get(args, i + 1))), lambda a: a.isNotNull())))
    out = F.coalesce("output", F.get(args, F.array_position(args, "-o").cast("int")))
    return rows.select("file", "directory", taken("-I").alias("include_dirs"), F.transform(taken("-D"), lambda d: F.split(d, "=")[0]).alias("defines"), F.when(F.array_position(args, "-o") > 0, out).otherwise(F.col("output")).alias("output"))


def overlay(files: DataFrame, database: DataFrame) -> DataFrame:
    """files (path, artifact_kind, header_role, ...) with what their compile entries say: tests, tools, editors."""
    test = F.exists("defines", lambda d: F.upper(d).contains("TEST") | F.upper(d).contains("BENCHMARK"))
    entries = database.select(F.col("file").alias("path"), test.alias("_test"), F.lower("output").alias("_output"))
    joined = files.join(entries, "path", "left")
    kind = F.when(F.col("artifact_kind") == "generated", "generated").when(F.col("_test"), "test").when(F.col("_output").rlike("(^|[/_-])tests?([/_.-]|$)"), "test").when(F.col("_output").contains("editor"), "editor").when(F.col("_output").rlike("(^|[/_-])tools?([/_.-]|$)"), "tool").otherwise(F.col("artifact_kind"))
    return joined.withColumn("artifact_kind", kind).drop("_test", "_output")

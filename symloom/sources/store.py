"""The stored index: tables as Parquet in generations, a pointer to the active one, JSON exchange, a parse cache."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators.incremental import mismatch_reason, old_generations
from symloom.schema import TABLES, struct

FORMAT_VERSION = "1"
POINTER = "active.json"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _read(spark: SparkSession, path: str) -> str | None:
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """Written aside and renamed: a reader sees the old text or the new."""
    fs, target = _fs(spark, path)
    _, aside = _fs(spark, f"{path}.next")
    stream = fs.create(aside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, target, over)


def generations(spark: SparkSession, root: str) -> list[str]:
    fs, target = _fs(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory() and s.getPath().getName().startswith("gen=")) if fs.exists(target) else []


def active(spark: SparkSession, root: str) -> str | None:
    """The generation that the pointer names, if it is a plain name of one that exists."""
    text = _read(spark, f"{root}/{POINTER}")
    name = json.loads(text).get("active", "") if text else ""
    return name if name in generations(spark, root) else None


def publish(spark: SparkSession, root: str, stamp: str, tables: dict[str, DataFrame], metadata: dict[str, str] | None = None, keep: int = 2) -> str:
    """Write a generation, point to it, and delete those that are neither active, previous nor among the `keep` latest."""
    name, before = f"gen={stamp}", active(spark, root)
    for table, rows in tables.items():
        fields = struct(table).fieldNames()
        present = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(struct(table)[c].dataType).alias(c) for c in fields])
        present.write.mode("overwrite").parquet(f"{root}/{name}/{table}")
    meta = {"format_version": FORMAT_VERSION, **(metadata or {})}
    spark.createDataFrame(list(meta.items()), TABLES["db_metadata"]).coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}/db_metadata")
    _replace(spark, f"{root}/{POINTER}", json.dumps({"active": name, "previous": before, "published_at": stamp}))
    for old in old_generations(generations(spark, root), name, before, keep):
        fs, target = _fs(spark, f"{root}/{old}")
        fs.delete(target, True)
    return name


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the active generation; an empty one where it was never written."""
    generation = active(spark, root)
    path = f"{root}/{generation}/{name}"
    fs, target = _fs(spark, path)
    if generation is None or not fs.exists(target):
        return spark.createDataFrame([], struct(name))
    return spark.read.schema(struct(name)).parquet(path)


def stale(spark: SparkSession, root: str, wanted: dict[str, str]) -> str | None:
    """Why the active generation cannot be used for what is wanted; null if it can."""
    stored = {r["key"]: r["value"] for r in table(spark, root, "db_metadata").collect()}  # a handful of rows
    return mismatch_reason(stored, {"format_version": FORMAT_VERSION, **wanted})


def read_json(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table from <folder>/<name>.json, an array of objects."""
    return spark.read.schema(struct(name)).json(f"{folder}/{name}.json", multiLine=True)


def write_json(rows: DataFrame, folder: str, name: str) -> None:
    rows.write.mode("overwrite").json(f"{folder}/{name}.json")


def cache_key(parser: str, version: str):
    """The key of a file's parse: parser, arguments, its content and that of the files it includes directly."""
    return F.sha2(F.concat_ws("\x1f", F.lit(parser), F.lit(version), F.array_join(F.array_sort("arguments"), " "), "content_hash", F.array_join(F.array_sort("include_hashes"), ",")), 256)


def cache_misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (cache_key, ...) that the cache (cache_key) has no parse of."""
    return files.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def trim_cache(cache: DataFrame, most: int) -> DataFrame:
    """The `most` entries stored last (stored_at)."""
    return cache.orderBy(F.desc("stored_at"), "cache_key").limit(most)

"""Cutting lineage: intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
_scopes: list[set[str]] = []


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="symloom-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, which only local mode may use."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{_own_folder()}"


def settle(df: DataFrame) -> DataFrame:
    """df, written once as Parquet in the shared folder and read from there: later actions start here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/symloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    for scope in _scopes:
        scope.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that no later action reads."""
    for table in tables:
        if path := getattr(table, "settled_at", None):
            _delete(path)


@contextmanager
def scope() -> Iterator[set[str]]:
    """The paths of what is settled inside, for discard_paths once no action reads them any more."""
    paths: set[str] = set()
    _scopes.append(paths)
    try:
        yield paths
    finally:
        _scopes.remove(paths)


def discard_paths(paths: set[str]) -> None:
    while paths:
        _delete(paths.pop())


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the JVM may be gone before us; the folder is then the cluster's to clean
            return


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

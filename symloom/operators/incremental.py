"""Incremental planning and upkeep: what changed, what it drags along, and what no longer holds."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.operators.traverse import levels


def plan(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, status): disk (path, content_hash; null where unreadable) against stored, one full outer join."""
    both = disk.select("path", F.col("content_hash").alias("d"), F.lit(True).alias("on_disk")).join(stored.select("path", F.col("content_hash").alias("s"), F.lit(True).alias("known")), "path", "full_outer")
    status = F.when(F.col("on_disk").isNull(), "removed_path").when(F.col("d").isNull(), "read_failed").when(F.col("known").isNull(), "new_path").when(F.col("d") == F.col("s"), "unchanged_content").otherwise("content_changed")
    return both.select("path", status.alias("status"))


def plan_paths(disk: DataFrame, stored: DataFrame, changed: DataFrame) -> DataFrame:
    """The plan of the changed paths (path) alone."""
    only = changed.select("path").distinct()
    return plan(disk.join(only, "path", "left_semi"), stored.join(only, "path", "left_semi"))


def rename_hints(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """(old_path, new_path): removed and new files of equal content, one to one in the order of paths."""
    gone = stored.join(disk.select("path"), "path", "left_anti")
    new = disk.join(stored.select("path"), "path", "left_anti").where("content_hash is not null")
    nth = F.row_number().over(Window.partitionBy("content_hash").orderBy("path"))
    left = gone.select("content_hash", F.col("path").alias("old_path"), nth.alias("n"))
    right = new.select("content_hash", F.col("path").alias("new_path"), nth.alias("n"))
    return left.join(right, ["content_hash", "n"]).select("old_path", "new_path")


def header_fanout(includes: DataFrame, changed: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(path, depth): the files that include a changed one (path), directly or not, themselves not changed."""
    edges = includes.where("not is_system_include").select(F.col("included_file").alias("src"), F.col("source_file").alias("dst"), F.col("line").alias("ord"))
    # one common seed: the set of all changed files
    start = edges.join(changed.select(F.col("path").alias("src")).distinct(), "src", "left_semi").select(F.lit("").alias("src"), "dst", "ord")
    reached = levels(edges.unionByName(start), changed.sparkSession.createDataFrame([("",)], "seed string"), max_depth)
    return reached.where("depth > 0").join(changed.select(F.col("path").alias("node")), "node", "left_anti").select(F.col("node").alias("path"), "depth")


def header_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_path, kind, n_added, n_removed, n_changed): what became of each file's symbols (id, file_path, signature, macro_sensitivity)."""
    old = before.select("file_path", "id", F.coalesce("signature", F.lit("")).alias("was"), F.lit(1).alias("b"))
    new = after.select("file_path", "id", F.coalesce("signature", F.lit("")).alias("now"), F.lit(1).alias("a"), (F.col("macro_sensitivity") == "high").alias("macro"))
    both = old.join(new, ["file_path", "id"], "full_outer")
    out = both.groupBy("file_path").agg(F.count(F.when(F.col("b").isNull(), 1)).alias("n_added"), F.count(F.when(F.col("a").isNull(), 1)).alias("n_removed"), F.count(F.when(F.col("was") != F.col("now"), 1)).alias("n_changed"), F.coalesce(F.max("macro"), F.lit(False)).alias("macro"))
    kind = F.when(F.col("macro"), "conservative").when(F.col("n_added") + F.col("n_removed") + F.col("n_changed") == 0, "body_only").otherwise("symbols_changed")
    return out.select("file_path", kind.alias("kind"), "n_added", "n_removed", "n_changed")


def narrow_impact(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """The files that refer to symbols (id)."""
    return references.join(symbols.select(F.col("id").alias("target_symbol_id")).distinct(), "target_symbol_id", "left_semi").select("file_path").distinct()


def threshold(base: int, files: int) -> int:
    """base, scaled with the root of the files beyond 5000."""
    return math.ceil(base * math.sqrt(files / 5000)) if files > 5000 else base


def escalation(planned: DataFrame, hints: DataFrame) -> DataFrame:
    """One row: whether so much changed that a full build is better (n_files, n_changed, n_renames, escalate)."""
    counts = planned.agg(F.count(F.lit(1)).alias("n_files"), F.count(F.when(F.col("status") != "unchanged_content", 1)).alias("n_changed")).crossJoin(hints.agg(F.count(F.lit(1)).alias("n_renames")))
    scaled = lambda base: F.when(F.col("n_files") > 5000, F.ceil(F.lit(base) * F.sqrt(F.col("n_files") / 5000))).otherwise(base)
    escalate = (F.col("n_renames") >= scaled(50)) | (F.col("n_changed") >= scaled(200)) | ((F.col("n_files") >= 20) & (F.col("n_changed") * 100 >= F.col("n_files") * 40))
    return counts.withColumn("escalate", escalate)


def bursts(changes: DataFrame, files: int, batch: int = 64, rolling: int = 96, seconds: int = 5) -> DataFrame:
    """(bucket, n, rolled, burst): changes (at) by tumbling windows; a burst is a full batch, or a full sum of a window and the one before."""
    start = F.window("at", f"{seconds} seconds")["start"]
    counted = changes.groupBy(start.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = counted.select((F.col("bucket") + F.make_dt_interval(secs=F.lit(seconds))).alias("bucket"), F.col("n").alias("m"))
    both = counted.join(before, "bucket", "left").withColumn("rolled", F.col("n") + F.coalesce("m", F.lit(0)))
    return both.select("bucket", "n", "rolled", ((F.col("n") >= threshold(batch, files)) | (F.col("rolled") >= threshold(rolling, files))).alias("burst"))


def normalise_events(events: DataFrame, root: str, extensions: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """(path): changed source files below root from file events (kind, path), once each, editors' temporary ends cut off."""
    path = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"(~|\.tmp|\.swp|\.bak)$", "")
    kept = events.where(F.col("kind").isin("create", "modify", "remove", "rename")).select(path.alias("path")).where(F.col("path").startswith(f"{root.rstrip('/')}/"))
    kept = kept.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))
    for pattern in ignore:
        kept = kept.where(~F.col("path").rlike(pattern))
    return kept.distinct()


def dangling_calls(calls: DataFrame, symbols: DataFrame, strict: bool = False) -> DataFrame:
    """Calls of unknown callees; by unknown callers too if strict."""
    ids = symbols.select("id").distinct()
    out = calls.join(ids.withColumnRenamed("id", "callee_id"), "callee_id", "left_anti")
    return out.unionByName(calls.join(ids.withColumnRenamed("id", "caller_id"), "caller_id", "left_anti")).distinct() if strict else out


def dangling_references(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """References with an unknown end, and inheritance from anything but a class or struct."""
    ends = symbols.select("id", F.col("type").isin("class", "struct").alias("is_class")).distinct()
    a = ends.select(F.col("id").alias("source_symbol_id"), F.lit(True).alias("a"))
    b = ends.select(F.col("id").alias("target_symbol_id"), F.col("is_class").alias("b"))
    both = references.join(a, "source_symbol_id", "left").join(b, "target_symbol_id", "left")
    return both.where("a is null or b is null or (category = 'inheritanceMention' and not b)").select(*references.columns)


def dangling_propagation(events: DataFrame, symbols: DataFrame) -> DataFrame:
    """Events that name an unknown owner, source or target; null names nobody."""
    ids = symbols.select("id").distinct()
    out = events
    for c in ("owner_symbol_id", "source_symbol_id", "target_symbol_id"):
        out = out.join(ids.select(F.col("id").alias(c), F.lit(True).alias(f"_{c}")), c, "left")
    missing: Column = F.lit(False)
    for c in ("owner_symbol_id", "source_symbol_id", "target_symbol_id"):
        missing = missing | (F.col(c).isNotNull() & F.col(f"_{c}").isNull())
    return out.where(missing).select(*events.columns)


def without_files(table: DataFrame, paths: DataFrame, column: str = "file_path") -> DataFrame:
    """A table without the rows of the paths (path)."""
    return table.join(paths.select(F.col("path").alias(column)).distinct(), column, "left_anti").select(*table.columns)


def replace_files(table: DataFrame, fresh: DataFrame, paths: DataFrame, column: str = "file_path") -> DataFrame:
    """A table in which the rows of the paths are the fresh ones: what an incremental build publishes."""
    return without_files(table, paths, column).unionByName(fresh)


def old_generations(names: Sequence[str], active: str, previous: str | None, keep: int) -> list[str]:
    """Of the published generations those to delete: all but the active, the previous and the `keep` latest by name."""
    held = {active, previous, *sorted(names, reverse=True)[:keep]}
    return [n for n in sorted(names) if n not in held]


def mismatch_reason(stored: dict[str, str], wanted: dict[str, str]) -> str | None:
    """The first of the index's properties that is not as wanted."""
    for key in ("format_version", "workspace_root", "workspace_name", "extensions_csv", "build_config_mtime"):
        if stored.get(key) != wanted.get(key):
            return key
    return None


def integrity(graph) -> DataFrame:
    """(rule, n): how many rows break each rule of the tables."""
    symbols = graph.symbols
    checks = {
        "symbol_id_unique": symbols.groupBy("id").count().where("count > 1"),
        "symbol_has_name": symbols.where("name is null or name = ''"),
        "end_after_line": symbols.where("end_line < line"),
        "callee_known": dangling_calls(graph.calls, symbols),
        "reference_ends_known": dangling_references(graph.symbol_references, symbols),
    }
    out = None
    for rule, rows in checks.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.union(one)
    return out


#: The window over which changes are watched for bursts.
BURST_WINDOW = timedelta(seconds=5)

"""Shaping of answers: windows, compact forms, ambiguity and usage statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From so many results on, answers are compact; candidates and queries shown.
COMPACT_FROM, SHOWN, QUERIES = 20, 5, 3


def compact(wanted: bool | None, n: Column) -> Column:
    """Whether an answer of n results is compact: as wanted, else by size."""
    return F.lit(wanted) if wanted is not None else n >= COMPACT_FROM


def result_window(total: Column, limit: int, offset: int = 0) -> Column:
    """returned, total, truncated, has_more and next_offset of a page."""
    returned = F.greatest(F.lit(0), F.least(F.lit(limit), total - offset)).cast("long")
    more = total > offset + limit
    return F.struct(returned.alias("returned"), total.alias("total"), more.alias("has_more"), F.when(more, offset + limit).alias("next_offset"))


def ambiguity(ranked: DataFrame) -> DataFrame:
    """Per name: candidates, those of the top score, the first five, and what tells them apart best."""
    top = ranked.withColumn("_top", F.max("score").over(Window.partitionBy("name")))
    columns = ("artifact_kind", "subsystem", "module", "file_path")
    firsts = F.array_sort(F.collect_list(F.when(F.col("rank") <= SHOWN, F.struct("rank", "qualified_name"))))
    out = top.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("score") == F.col("_top"), 1)).alias("n_top"), F.array_join(F.transform(firsts, lambda f: f["qualified_name"]), ",").alias("candidates"), *[F.count_distinct(c).alias(f"d_{c}") for c in columns])
    most = F.greatest(*[F.col(f"d_{c}") for c in columns])
    chosen = F.coalesce(*[F.when((F.col(f"d_{c}") == most) & (most > 1), c) for c in columns])
    return out.select("name", "n", "n_top", "candidates", chosen.alias("discriminator"))


def tool_stats(calls: DataFrame) -> DataFrame:
    """Per tool (tool_name, elapsed_ms, ok, called_at): calls, errors, total and mean time in hundredths, the last call."""
    return calls.groupBy("tool_name").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("ok"), 1)).alias("n_errors"), F.round(F.sum(F.col("elapsed_ms").cast("decimal(18,2)")), 2).cast("double").alias("total_ms"), F.max("called_at").alias("last_at"))


def recent_calls(calls: DataFrame, n: int = 20) -> DataFrame:
    """The newest n calls."""
    return calls.orderBy(F.desc("called_at"), F.desc("k")).limit(n).select("k", "tool_name", "called_at")


#: The columns of compact answers.
COMPACT_COLUMNS = {
    "symbol": ("id", "qualified_name", "type", "file_path", "line"),
    "caller": ("callee_id", "caller_id", "file_path", "line"),
    "reference": ("target_symbol_id", "source_symbol_id", "category", "file_path", "line"),
    "member": ("owner", "id", "type"),
    "propagation": ("id", "side", "propagation_kind", "file_path", "line"),
}


def compact_rows(rows: DataFrame, kind: str) -> DataFrame:
    """The columns of rows that a compact answer of the kind has."""
    return rows.select(*[c for c in COMPACT_COLUMNS[kind] if c in rows.columns])

"""From raw documents to token ids: five stages over the whole corpus, each on all that the one before it kept.

Every stage numbers the rows that it reads and decides row by row, so rows with a null doc_id are judged like others, and
of rows that share a doc_id each is judged by its own text. Null and empty texts go in the first stage. Repeated rows
go in the second but for one. Empty tables give no rows (documents) or let all documents pass (labels, benchmark).
Columns of documents beyond the five known ones are carried along, whatever their names.
"""

from __future__ import annotations

import threading
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.decontaminate import decontaminate
from symloom.llm.exact_dedup import exact_dedup
from symloom.llm.near_dedup import near_duplicates
from symloom.llm.perplexity import classify
from symloom.llm.pieces import encode_pieces
from symloom.llm.queries import vocabulary
from symloom.llm.storage import discard_paths, scope, settle


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, and the name of that column.

    The number is the row's place in the files that docs is read from, the same in each pass over them.
    """
    name = "row"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def _only(rows: DataFrame, number: str, kept: DataFrame) -> DataFrame:
    """The rows with the numbers in kept, without the number. By shuffle at every size: numbers grow with docs."""
    return rows.join(kept.select(number).hint("shuffle_hash"), number, "left_semi").drop(number)


_scratch = threading.local()


def _stage(function):
    """What a stage settles stays until the same thread begins another stage: the result is written by then, as STAGES asks."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_paths(getattr(_scratch, "paths", set()))
        with scope() as _scratch.paths:
            return function(spark, docs, sf_dir)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is no worse than that of trusted text."""
    rows, number = _numbered(docs)
    judged = classify(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=(number,))
    return _only(rows, number, judged.where("kept"))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that with the most characters, then the smallest doc_id."""
    rows, number = _numbered(docs)
    return _only(rows, number, exact_dedup(rows, keep=(number,)).where("kept"))


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id: five-word shingles, similarity of 0.8 or more."""
    rows, number = _numbered(docs)
    judged = near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"), percent=80, width=5)
    grouped = judged.select(F.col("doc_id").alias(number), "component_id").join(rows.select(number, "doc_id"), number)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(number))
    return _only(rows, number, grouped.groupBy("component_id").agg(F.min_by(number, order).alias(number)))


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    rows, number = _numbered(docs)
    judged = decontaminate(rows.select(F.col(number).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _only(rows, number, judged.where("not contaminated").withColumnRenamed("doc_id", number))


@_stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every document."""
    ids = encode_pieces(docs, vocabulary("piece_bpe_32k.model"), keep=("lang", "source"))
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminated), ("encoding", encoded)]

#: SQL can't express perplexity under a trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries of this subpackage: thin digests over the operators, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.decontaminate import decontaminate
from symloom.llm.exact_dedup import exact_dedup
from symloom.llm.line_dedup import line_dedup
from symloom.llm.near_dedup import near_duplicates
from symloom.llm.perplexity import classify
from symloom.llm.pieces import decode_pieces, encode_pieces
from symloom.llm.sharding import kd_shards
from symloom.llm.substring_dedup import substring_dedup
from symloom.llm.token_counts import token_counts
from symloom.llm.url_filter import judge_urls

#: The rules of op6: fixed values.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"), min_sites=10).select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), width=20).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def vocabulary(name: str) -> str:
    """The place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_hash (xxhash64 of the ids), restored (decoding gives the text, U+2581 as a space)."""
    model = vocabulary("piece_bpe_32k.model")
    decoded = decode_pieces(encode_pieces(_table(spark, sf_dir, "documents"), model), model)
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit("\u2581"), F.lit(" "))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), (F.col("decoded") == plain).alias("restored"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85, width=5)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards(_table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_substring_dedup, op3_quality_classifier, op4_token_counts, op5_sentencepiece, op6_url_filter, op7_minhash_dedup, op8_exact_dedup, op9_decontamination, op10_kd_sharding)}

"""Line deduplication by distinct-site spread: lines that many sites share are boilerplate and go.

The occurrences of a line on a site are first added up, in each task and then over the shuffle, so a hot line leaves a
task as one row a site. Every line hash then gets a HyperLogLog sketch of its sites; sketches of the same hash are begun
in each task and merged by aggregation. Estimates clear of the threshold decide; within `SIGMAS` standard errors of it
the distinct sites are counted exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.storage import settle

LG_K = 10
SIGMAS = 4.0
_BLANKS = "\x20\x09\x0b\x0c\x0d"


def _parts(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_spread(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2) of the lines seen on min_sites distinct sites or more; lines has h1, h2, site."""
    seen = settle(lines.groupBy("h1", "h2", "site").agg(F.count(F.lit(1)).alias("n")))
    sketched = settle(seen.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites")).where(F.col("n") >= min_sites))
    band = max(1, math.ceil(SIGMAS * 1.04 / 2 ** (LG_K / 2) * min_sites))
    near = sketched.where((F.col("sites") >= min_sites - band) & (F.col("sites") <= min_sites + band)).select("h1", "h2")
    exact = seen.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites)
    return sketched.where(F.col("sites") > min_sites + band).select("h1", "h2").union(exact.select("h1", "h2"))


def line_dedup(docs: DataFrame, min_sites: int = 10, site: str = "source") -> DataFrame:
    """doc_id, n_lines, n_removed, kept (the text without the removed lines) of every row of docs.

    Lines are what \\n parts; they are compared without blanks at either end. A line goes, wherever it stands, when at
    least min_sites distinct values of the column `site` have it (null is a value of its own); blank lines stay. A null
    text has no lines and is kept as empty; an empty one has one blank line. Null ids are judged like others, repeated
    rows are repeated and count as seen twice on one site; no rows give no rows; other columns are not read.
    """
    text = F.col("text").cast("string")
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k1"), F.xxhash64(F.coalesce(text, F.lit("")), F.col("doc_id").isNull()).alias("k2")]
    where = F.coalesce(F.col(site).cast("string"), F.lit("\x00"))
    exploded = docs.select(*keys, where.alias("site"), F.posexplode(_parts(text)).alias("at", "line")).withColumn("line", F.trim("line", F.lit(_BLANKS)))
    lines = settle(exploded.where("line != ''").select("k1", "k2", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")))
    gone = lines.join(line_spread(lines, min_sites), ["h1", "h2"]).groupBy("k1", "k2").agg(F.collect_set("at").alias("gone"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *keys).join(gone, ["k1", "k2"], "left")
    rows = rows.withColumn("lines", _parts(F.col("text")))
    # array_except looks positions up by hash: linear in a text's lines
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stays, lambda at: F.get("lines", at)), "\n"))
    return rows.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.coalesce(kept, F.lit("")).alias("kept"),
    )

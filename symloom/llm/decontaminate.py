"""Benchmark decontamination by a prefix-filtered join of word shingles; DataFrame functions only.

Where an item's window occurs all its shingles occur, so one shingle a window suffices to find it: the prefix of a set
that must be contained whole. Shingles are ordered by rarity (in how many different windows they stand, then the longer
first, then the words themselves), the first of each window is its prefix, and documents are joined with prefixes alone.
A prefix knows where in windows of which length it stands; bounds on positions and lengths drop places where no such
window fits. What is left is verified: the document's words there are joined with the windows and compared.

The texts are read once where the prefixes are broadcast. What is kept of them are the words around prefixes and the
number of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.storage import discard, settle

#: Prefixes are broadcast up to so many (about 150 bytes each), and so are windows; more are joined by shuffle.
BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3


def words(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text after A-Z are lower-cased; null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    parts = F.split(lower, _GAP)
    # only a text that begins or ends with a gap has empty parts, the first or the last
    first = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)
    last = F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.slice(parts, first, F.greatest(last - first + 1, F.lit(0)))


def _shingles(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """Rows with `words` exploded to at (position), k, hash and w1..w3; a row without words has at null once."""
    w = F.col("words")
    rest = lambda k: F.when(F.size(w) >= k, F.slice(w, k, F.greatest(F.size(w) - k + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    own = rows.columns
    out = rows.select(*own, F.posexplode_outer(F.arrays_zip(w.alias("a"), rest(2).alias("b"), rest(3).alias("c"))).alias("at", "z"))
    out = out.select(*own, "at", F.col("z.a").alias("w1"), F.col("z.b").alias("w2"), F.col("z.c").alias("w3"))
    if sizes == [SHINGLE]:
        out = out.withColumn("k", F.lit(SHINGLE))
    else:
        cuts = [F.struct(F.lit(k).alias("k"), *(F.col(f"w{j}") if j <= k else F.lit(None).cast("string").alias(f"w{j}") for j in (1, 2, 3))) for k in sizes]
        out = out.select(*own, "at", F.explode(F.array(*cuts)).alias("z")).select(*own, "at", "z.*")
    return out.withColumn("hash", F.xxhash64("k", "w1", "w2", "w3"))


def _prefixes(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """k, w1..w3, hash, spots of the prefixes of windows (win, words): spots are (offset, need), few for each."""
    placed = _shingles(windows.withColumn("own", F.least(F.lit(SHINGLE), F.size("words"))), sizes).where("k = own and at + k <= size(words)")
    shingle = ["k", "w1", "w2", "w3", "hash"]
    standing = placed.select("win", "at", F.size("words").alias("need"), *shingle)
    rarity = standing.groupBy(*shingle).agg(F.count_distinct("win").alias("n"))
    same = F.lit(True)
    for c in shingle:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}"))
    ranked = standing.alias("s").join(rarity.alias("r"), same).select("s.*", "n")
    length = F.char_length(F.concat_ws("", "w1", "w2", "w3"))
    first = ranked.groupBy("win").agg(F.min_by(F.struct("at", "need", *shingle), F.struct("n", -length, "w1", "w2", "w3", "at")).alias("p")).select("p.*")
    return first.groupBy(*shingle).agg(F.collect_set(F.struct(F.col("at").alias("offset"), "need")).alias("spots"))


def _spans(hits: DataFrame) -> DataFrame:
    """doc, start, span of hits (doc, words, at, spots): the words where a window with the prefix fits."""
    out = hits.select("doc", "words", "at", F.explode("spots").alias("s")).select("doc", "words", (F.col("at") - F.col("s.offset")).alias("start"), "s.need")
    return out.where("start >= 0 and start + need <= size(words)").select("doc", "start", F.slice("words", F.col("start") + 1, F.col("need")).alias("span"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs.

    A window is `window` consecutive words of an item, or the whole item if it has fewer (but some). A document word
    inside any occurrence of a window is hit; n_items counts the item_ids with occurring windows, items_sha256 is the
    SHA-256 of those ids, sorted as strings and comma-joined. Null texts have no words and are never hit; items
    without words or with a null id match nothing; repeated items count once, texts that share an item_id are judged
    one by one. Every row is judged by itself: a null doc_id stays
    null, rows that share a doc_id may differ, repeated rows are repeated. A text is held whole by one task. No rows give no
    rows; an empty benchmark hits nothing; other columns are not read.
    """
    items = (
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
        .where("item_id is not null and size(words) > 0").distinct()
    )
    need = F.least(F.lit(window), F.size("words"))
    starts = F.sequence(F.lit(0), F.size("words") - need)
    standing = settle(items.select("item_id", F.explode(F.transform(starts, lambda at: F.slice("words", at + 1, need))).alias("words")).distinct())
    windows = settle(standing.select("words").distinct().withColumn("win", F.monotonically_increasing_id()))
    of_items = standing.join(windows, "words").select("win", "item_id")
    sizes = sorted(r[0] for r in windows.select(F.least(F.lit(SHINGLE), F.size("words"))).distinct().collect()) or [SHINGLE]  # three values at most
    prefixes = settle(_prefixes(windows, sizes))
    n_prefixes, n_windows, n_standing = prefixes.count(), windows.count(), standing.count()

    same = F.lit(True)
    for c in ("k", "w1", "w2", "w3"):
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}"))
    same = same & (F.col("d.hash") == F.col("b.hash"))
    # a number for each row, given once: what carries it is written down
    numbered = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("doc"), F.col("text"))
    if n_prefixes <= broadcast_rows:
        places = _shingles(numbered.select("doc_id", "doc", words(F.col("text")).alias("words")), sizes)
        last = (F.col("at").isNull() | (F.col("at") == F.size("words") - 1)) & (F.col("d.k") == sizes[-1])
        met = places.alias("d").join(F.broadcast(prefixes).alias("b"), same, "left").where(F.col("spots").isNotNull() | last)
        # an empty spot stands for the row itself, once, at its last place
        none = F.array().cast("array<struct<offset:int,need:int>>")
        empty = F.array(F.lit(None).cast("struct<offset:int,need:int>"))
        met = met.select("doc_id", "doc", "words", "at", F.explode(F.concat(F.coalesce("spots", none), F.when(last, empty).otherwise(none))).alias("s"))
        met = met.withColumn("start", F.col("at") - F.col("s.offset")).where("s is null or (start >= 0 and start + s.need <= size(words))")
        span = F.when(F.col("s").isNotNull(), F.slice("words", F.col("start") + 1, F.col("s.need")))
        seen = settle(met.select("doc_id", "doc", F.size("words").cast("long").alias("n_words"), "start", span.alias("span")))
        rows, spans = seen.where("span is null").select("doc_id", "doc", "n_words"), seen.where("span is not null").select("doc", "start", "span")
    else:
        numbered = settle(numbered)
        counted = numbered.select("doc_id", "doc", words(F.col("text")).alias("words"))
        places = _shingles(counted.select("doc", "words"), sizes).where("at is not null").drop("words")
        hits = settle(places.alias("d").join(prefixes.hint("shuffle_hash").alias("b"), same).select("doc", "at", "spots"))
        rows, spans = counted.select("doc_id", "doc", F.size("words").cast("long").alias("n_words")), _spans(counted.select("doc", "words").join(hits, "doc"))

    keyed = windows.withColumn("key", F.xxhash64("words"))
    keyed = F.broadcast(keyed) if n_windows <= broadcast_rows else keyed
    found = spans.withColumn("key", F.xxhash64("span")).alias("d").join(keyed.alias("b"), (F.col("d.key") == F.col("b.key")) & (F.col("span") == F.col("words")))
    found = found.select("doc", "win", F.struct(F.col("start").cast("long").alias("a"), (F.col("start") + F.size("span")).cast("long").alias("b")).alias("range"))
    covered = F.aggregate(
        F.array_sort("ranges"),
        F.struct(F.lit(0).cast("long").alias("until"), F.lit(0).cast("long").alias("n")),
        lambda acc, r: F.struct(F.greatest(acc["until"], r["b"]).alias("until"), (acc["n"] + F.greatest(F.lit(0).cast("long"), r["b"] - F.greatest(r["a"], acc["until"]))).alias("n")),
        lambda acc: acc["n"],
    )
    occurring = settle(found.groupBy("doc").agg(F.collect_set("range").alias("ranges"), F.collect_set("win").alias("wins")).select("doc", covered.alias("n_hit"), "wins"))
    ids = occurring.select("doc", F.explode("wins").alias("win")).join(F.broadcast(of_items) if n_standing <= broadcast_rows else of_items, "win")
    ids = ids.groupBy("doc").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    judged = occurring.select("doc", "n_hit").join(ids, "doc").select("doc", "n_hit", F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("ids"))
    return rows.join(judged, "doc", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


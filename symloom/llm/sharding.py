"""Sharding by a k-d tree: nodes are cut at weighted medians along the metadata dimension that is widest in them.

Every row gets one 62-bit key per dimension: 31 bits of the metadata value and 31 bits that spread equal values, so
that a source with a third of all rows can be cut as finely as any other. Cuts are found for all nodes of a level at
once by histograms of at most `BINS` bins a node, refined until the bin that holds the cut is light; only those
histograms (shards x BINS rows at most) reach the driver, never rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.llm.storage import settle

BINS = 1024
_SPREAD = 2**31
#: Rows of a shard that one task numbers.
SLOT_ROWS = 500


@dataclass
class _Node:
    leaves: int
    first: int = 0  # the first shard below
    dimension: str | None = None
    cut: int = 0
    below: tuple[_Node, _Node] | None = None
    # while the cut is sought
    low: int = 0
    high: int = 0
    target: float = 0
    before: float = 0
    number: int = field(default=-1)


def _place(node: _Node, leaf) -> Column:
    """leaf(node) of the node without children where a row lies."""
    if node.below is None:
        return leaf(node)
    left, right = node.below
    return F.when(F.col(node.dimension) < node.cut, _place(left, leaf)).otherwise(_place(right, leaf))


def _ends(node: _Node) -> list[_Node]:
    return [node] if node.below is None else _ends(node.below[0]) + _ends(node.below[1])


def _key(name: str, value: Column) -> Column:
    tie = F.pmod(F.xxhash64(F.col("row_key"), F.lit(name)), F.lit(_SPREAD))
    return (value.cast("long") * _SPREAD + tie).alias(name)


def _category(name: str) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit("category")), F.lit(_SPREAD))


def _find_cuts(rows: DataFrame, root: _Node, open_nodes: list[_Node], light: float) -> None:
    """Sets cut of every open node: the weight below it is nearest to target."""
    seeking = list(open_nodes)
    while seeking:
        for number, node in enumerate(_ends(root)):
            node.number = number if node in seeking else -1
        by_number = {node.number: node for node in seeking}
        widths = {k: max(1, math.ceil((n.high - n.low) / BINS)) for k, n in by_number.items()}

        def bin_of(node: _Node) -> Column:
            if node.number < 0:
                return F.lit(None).cast("long")
            inside = (F.col(node.dimension) >= node.low) & (F.col(node.dimension) < node.high)
            return F.when(inside, F.floor((F.col(node.dimension) - node.low) / widths[node.number]) + node.number * 2 * BINS)

        bins = rows.groupBy(_place(root, bin_of).cast("long").alias("bin")).agg(F.sum("size").alias("weight")).where("bin is not null")
        weights: dict[int, dict[int, float]] = {k: {} for k in by_number}
        for r in bins.collect():  # at most shards x BINS rows
            weights[r["bin"] // (2 * BINS)][r["bin"] % (2 * BINS)] = r["weight"]
        still = []
        for k, node in by_number.items():
            for b in sorted(weights[k]):
                w = weights[k][b]
                if node.before + w >= node.target:
                    break
                node.before += w
            else:
                node.cut = node.high
                continue
            low = node.low + b * widths[k]
            node.low, node.high = low, min(node.high, low + widths[k])
            if w <= light or node.high - node.low <= 1:
                node.cut = node.low if node.target - node.before <= node.before + w - node.target else node.high
            else:
                still.append(node)
        seeking = still


def kd_shards(docs: DataFrame, shards: int = 40, target_bytes: int | None = None, categories: tuple[str, ...] = ("source", "lang"), keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 within a shard) of every row of docs.

    size is the text's UTF-8 bytes plus 16, text_crc32 the unsigned CRC-32 of those bytes; a null text has none of
    them: 16 and 0. With target_bytes, the number of shards is what the rows need at that size. The dimensions are the
    text's size and the given columns (missing or null ones are one value). Shards differ by about one row and 0.2 %
    of a shard. Null ids are spread too; repeated rows may lie in different shards only if their ids are null; no rows
    give no rows. Columns named in keep are carried along.
    """
    text = F.col("text").cast("string")
    present = [c for c in categories if c in docs.columns]
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id()).alias("row_key"),
        *[_category(c).alias(f"_{c}") for c in present],
        *keep,
    )
    scaled = F.round(F.log2(F.col("size")) / 64 * (_SPREAD - 1))
    dimensions = ["k_size", *(f"k_{c}" for c in present)]
    rows = settle(base.select("doc_id", "size", "text_crc32", "row_key", _key("k_size", scaled), *[_key(f"k_{c}", F.col(f"_{c}")) for c in present], *keep))

    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    total = total or 0
    if target_bytes:
        shards = max(1, math.ceil(total / target_bytes))
    root = _Node(shards)
    while total and (open_nodes := [n for n in _ends(root) if n.leaves > 1 and n.cut != -1]):
        for number, node in enumerate(_ends(root)):
            node.number = number
        ranges = [f(d).alias(f"{at}_{d}") for d in dimensions for at, f in (("low", F.min), ("high", F.max))]
        seen = {r["node"]: r for r in rows.groupBy(_place(root, lambda n: F.lit(n.number)).alias("node")).agg(F.sum("size").alias("weight"), *ranges).collect()}
        for node in list(open_nodes):
            r = seen.get(node.number)
            if r is None:  # no rows: its shards stay empty
                node.cut = -1
                open_nodes.remove(node)
                continue
            node.dimension = max(dimensions, key=lambda d: r[f"high_{d}"] - r[f"low_{d}"])
            node.low, node.high = r[f"low_{node.dimension}"], r[f"high_{node.dimension}"] + 1
            node.target, node.before = r["weight"] * (node.leaves // 2) / node.leaves, 0
        _find_cuts(rows, root, open_nodes, total / shards / 2000)
        for node in open_nodes:
            left = node.leaves // 2
            node.below = _Node(left, node.first), _Node(node.leaves - left, node.first + left)

    placed = rows.withColumn("shard", _place(root, lambda n: F.lit(n.first)).cast("int"))
    parts = max(1, math.ceil(count / shards / SLOT_ROWS))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row_key", F.lit("slot")), F.lit(parts)).cast("int"))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "part").orderBy("row_key", "text_crc32", "size")
    slot = F.row_number().over(order) - 1
    return placed.withColumn("slot", slot).join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("start")).cast("long").alias("slot"), *keep)

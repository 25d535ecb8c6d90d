"""Substring deduplication: prefix-partitioned suffix trees, whose deep internal nodes give the maximal repeats.

1. Which suffixes begin a repeat is asked of the whole corpus (`exchange`): a window (`width` words) that occurs once is
   a leaf of its own and needs no tree; of the others it is told whether different words stand before its occurrences.
   A repeat that always follows the same word is part of a longer one, so only suffixes with different words before
   them enter trees, and one more each `REACH` windows of a stretch, so that no suffix is longer than a stretch.
2. Suffixes are split by prefix. The bytes below each word prefix are counted level by level; a prefix with more than
   `TREE_BYTES` below it is lengthened until each of its longer ones fits. Equal suffixes are merged in the task that
   cuts them, so copies by the thousand count as one; where a whole window still has more below it, its suffixes are
   cut into windows, and those are merged in the tasks that read them.
3. Each prefix's suffixes make one suffix tree. A node at least `width` words deep is a repeat; the windows that
   begin between its parent's depth and its own occur at all leaves below it, first at the smallest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.exchange import ASKED, answers, ask, passed, read_answers
from symloom.llm.near_dedup import _groups
from symloom.llm.storage import discard, settle, shuffle_partitions
from symloom.llm.words import gram_hashes, mix, spans, word_hashes

#: Bytes of text of one chunk, of the keys that one range answers (times 12), and below one prefix.
CHUNK_BYTES, PART_BYTES, TREE_BYTES = 4_000_000, 12_000_000, 1_000_000
REACH = 32
#: Suffixes, and windows of too common prefixes, that a task holds to merge equal ones.
HELD = 50_000
#: Prefixes too common for one tree are broadcast up to so many.
BROADCAST_ROWS = 500_000
_SUFFIXES = "doc_id long, digest long, at long, body string"
_SUFFIX_TYPES = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("at", pa.int64()), ("body", pa.string())])
_MERGED = f"{_SUFFIXES}, n long"
_MERGED_TYPES = _SUFFIX_TYPES.append(pa.field("n", pa.int64()))
_MARKS = "doc_id long, digest long, code long"
_MARK_TYPES = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("code", pa.int64())])


class _Chunk:
    """The windows of a chunk's documents, in an order that does not depend on that of the rows."""

    def __init__(self, rows: pa.Table, width: int) -> None:
        rows = rows.sort_by([("doc_id", "ascending"), ("digest", "ascending")])
        self.number = rows.column("chunk")[0].as_py() if len(rows) else -1
        self.ids = list(zip(rows.column("doc_id").to_pylist(), rows.column("digest").to_pylist(), strict=True))
        self.texts: list[bytes] = []
        hashes, before, sizes = [], [], []
        for (doc_id, digest), text in zip(self.ids, rows.column("text"), strict=True):
            data = text.as_py().encode()
            starts, ends = spans(data)
            words = word_hashes(data, starts, ends)
            grams = gram_hashes(words, width)
            hashes.append(grams)
            # before the first word stands a text's beginning, another one for each text
            beginning = mix(np.array([doc_id * 31 + digest & 2**64 - 1], np.uint64))
            before.append(np.concatenate([beginning, words])[: len(grams)])
            sizes.append(len(grams))
            self.texts.append(data)
        self.windows = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.before = (np.concatenate(before) if before else np.zeros(0, np.uint64)) & np.uint64((1 << 48) - 1)
        self.ends = np.cumsum(np.array(sizes, np.int64))

    def shortened(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct shortened windows, where each window is among them, and how often they occur here."""
        return np.unique(self.windows >> np.uint64(64 - bits), return_inverse=True, return_counts=True)


def _ask_first(parts: int, bits: int, width: int):
    """From a chunk's texts: the blocks of shortened windows."""

    def run(rows: pa.Table) -> pa.Table:
        chunk = _Chunk(rows, width)
        keys, _, n = chunk.shortened(bits)
        return ask(chunk.number, keys, (n > 1).astype(np.uint8), None, parts, bits)

    return run


def _told(table: pa.Table) -> list[tuple[int, bytes]]:
    return list(zip(table.column("part").to_pylist(), table.column("bits").to_pylist(), strict=True))


def _distinct(chunk: _Chunk, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows among those that may repeat, how often each occurs here, and the word before each occurrence."""
    hashes, before = chunk.windows[may], chunk.before[may]
    order = np.argsort(hashes, kind="stable")
    hashes, before = hashes[order], before[order]
    return hashes, before, np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)


def _ask_second(parts: int, bits: int, width: int):
    """From a chunk's texts and the first answers: blocks of the windows that may repeat, with the words before them."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        chunk = _Chunk(rows, width)
        keys, at, _ = chunk.shortened(bits)
        may = read_answers(keys, _told(told), parts, bits)[0][at]
        hashes, before, heads = _distinct(chunk, may)
        if not len(heads):
            return passed(chunk.number, np.packbits(may).tobytes())
        n = np.diff(np.append(heads, len(hashes)))
        differ = np.minimum.reduceat(before, heads) != np.maximum.reduceat(before, heads)
        flags = (n > 1).astype(np.uint8) | differ.astype(np.uint8) << 1
        return pa.concat_tables([ask(chunk.number, hashes[heads], flags, before[heads], parts), passed(chunk.number, np.packbits(may).tobytes())])

    return run


def _cut(parts: int, width: int):
    """From a chunk's texts and the second answers: the suffixes that enter trees, each as long as its stretch."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        out: list[tuple] = []
        chunk = _Chunk(rows, width)
        both = _told(told)
        may = next((np.unpackbits(np.frombuffer(data, np.uint8), count=len(chunk.windows)).astype(bool) for part, data in both if part < 0), None)
        if may is not None and may.any():
            hashes, _, heads = _distinct(chunk, may)
            facts = read_answers(hashes[heads], [x for x in both if x[0] >= 0], parts)
            which = np.searchsorted(hashes[heads], chunk.windows[may])
            repeats, varied = np.zeros(len(may), bool), np.zeros(len(may), bool)
            repeats[may], varied[may] = facts[0][which], (facts[0] & facts[1])[which]
            enters = varied.copy()
            place = np.arange(len(may))
            enters |= repeats & ((place - np.maximum.accumulate(np.where(varied, place, 0))) % REACH == 0)
            first = 0
            for k, end in enumerate(chunk.ends.tolist()):
                starts = np.flatnonzero(enters[first:end])
                if len(starts):
                    # a stretch ends before the next suffix that enters, or at its last repeated window
                    alone = np.append(np.flatnonzero(~repeats[first:end]), end - first)
                    stops = np.minimum(np.append(starts[1:], end - first), alone[np.searchsorted(alone, starts)])
                    words = chunk.texts[k].split()
                    out += [(*chunk.ids[k], a, b" ".join(words[a : b + width - 1])) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                first = end
        columns = list(zip(*out, strict=True)) or [()] * 4
        made = [pa.array(c, pa.int64()) for c in columns[:3]]
        return pa.table([*made, pa.array(columns[3], pa.binary()).cast(pa.string())], schema=_SUFFIX_TYPES)

    return run


def _merge(width: int, by_window: bool):
    """From suffixes: equal ones merged as far as a task holds them; with by_window their windows, one by one.

    A row without a body is the mark of n windows that occur earlier; n is 0 in the others.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners: dict[str, tuple[int, int, int]] = {}
        late: list[tuple] = []

        def flush() -> pa.RecordBatch:
            late.extend((*place, body, 0) for body, place in owners.items())
            columns = list(zip(*late, strict=True)) or [()] * 5
            owners.clear(), late.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MERGED_TYPES, strict=True)], schema=_MERGED_TYPES)

        def add(body: str, mine: tuple[int, int, int], n: int) -> None:
            other = owners.setdefault(body, mine)
            if mine != other:
                owners[body] = min(mine, other)
                late.append((*max(mine, other), None, n))

        for batch in batches:
            for doc_id, digest, at, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "at", "body")), strict=True):
                n = body.count(" ") + 2 - width
                if by_window and n > 1:
                    words = body.split(" ")
                    for k in range(n):
                        add(" ".join(words[k : k + width]), (doc_id, digest, at + k), 1)
                else:
                    add(body, (doc_id, digest, at), n)
                if len(owners) + len(late) > HELD:
                    yield flush()
        yield flush()

    return run


class SuffixTree:
    """The suffix tree of some suffixes (words, each with a blank behind it, and a leaf) below one prefix."""

    def __init__(self, suffixes: list[tuple[bytes, tuple]]) -> None:
        self.leaves = sorted(suffixes)
        #: the internal nodes, deeper ones first below each: (depth in words, depth of the parent, first leaf, end of leaves)
        self.nodes: list[tuple[int, int, int, int]] = []
        stack: list[tuple[int, int]] = []  # depth, first leaf
        for k in range(1, len(self.leaves) + 1):
            shared = _shared_words(self.leaves[k - 1][0], self.leaves[k][0]) if k < len(self.leaves) else 0
            first = k - 1
            while stack and stack[-1][0] > shared:
                depth, first = stack.pop()
                self.nodes.append((depth, max(shared, stack[-1][0] if stack else 0), first, k))
            if shared and (not stack or stack[-1][0] < shared):
                stack.append((shared, first))

    def repeats(self, width: int) -> Iterator[tuple[int, int, list[tuple]]]:
        """Of each node at least width deep: the first offset and the number of the windows that end below its parent, its leaves."""
        for depth, above, first, end in self.nodes:
            if depth >= width:
                low = max(0, above - width + 1)
                yield low, depth - width + 1 - low, [leaf for _, leaf in self.leaves[first:end]]


def _shared_words(a: bytes, b: bytes) -> int:
    if b.startswith(a):
        return a.count(b" ")
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return a.count(b" ", 0, low)


def _grow(width: int):
    """From suffixes sorted by prefix: start << 20 | n of the n windows from start on that occur earlier."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: list[tuple[int, int, int]] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*marks, strict=True)) or [()] * 3
            marks.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_MARK_TYPES)

        for group in _groups(batches, ["key"]):
            if len(group) > 1:
                leaves = zip(*(group.column(c).to_pylist() for c in ("doc_id", "digest", "at")), strict=True)
                suffixes = [(body.encode() + b" ", leaf) for body, leaf in zip(group.column("body").to_pylist(), leaves, strict=True)]
                for low, n, below in SuffixTree(suffixes).repeats(width):
                    first = min(below)
                    marks += [(doc, digest, at + low << 20 | n) for doc, digest, at in below if (doc, digest, at) != first]
            if len(marks) > 50_000:
                yield flush()
        yield flush()

    return run


def _keep(width: int):
    """From texts and marks: what is kept."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept = [], [], []
            for text, codes in zip(batch.column("text"), batch.column("codes"), strict=True):
                words = (text.as_py() or "").encode().split()
                sizes.append(len(words))
                if codes.is_valid:
                    marks = codes.values.to_numpy(zero_copy_only=False)
                    first = marks >> 20
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, first, 1)
                    np.add.at(cover, first + (marks & 0xFFFFF) + width - 1, -1)
                    stays = np.cumsum(cover[:-1]) == 0
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                gone.append(sizes[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _levels(width: int) -> list[int]:
    """Words of the prefixes that are tried: 1, 2, 4 and so on, at last a whole window."""
    return [2**k for k in range(width.bit_length()) if 2**k < width] + [width]


def prefixed(suffixes: DataFrame, width: int, tree_bytes: int) -> DataFrame:
    """Suffixes with key, a hash of the shortest prefix that has at most tree_bytes below it; null where even a window has more."""
    keyed, key = suffixes, F.lit(None).cast("long")
    chosen = []
    for words in _levels(width):
        prefix = F.xxhash64(F.lit(words), F.substring_index("body", " ", words))
        # at most (bytes of all suffixes) / tree_bytes rows
        common = settle(suffixes.groupBy(prefix.alias("prefix")).agg(F.sum(F.octet_length("body") + 32).alias("bytes")).where(F.col("bytes") > tree_bytes).select("prefix", F.lit(True).alias(f"common_{words}")))
        count = common.count()
        side = F.broadcast(common) if count <= BROADCAST_ROWS else common
        chosen.append((F.col(f"common_{words}").isNull(), prefix))
        keyed = keyed.join(side, prefix == F.col("prefix"), "left").drop("prefix")
        if not count:  # then no longer prefix has more either
            break
    for fits, prefix in reversed(chosen):
        key = F.when(fits, prefix).otherwise(key)
    return keyed.select(*suffixes.columns, key.alias("key"))


def late_windows(docs: DataFrame, width: int = 20, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """(doc_id, digest, code) of the windows that also start earlier: code is start << 20 | n for n windows in line.

    docs has doc_id, digest and text, none of them null; of different texts with one doc_id the smaller digest is earlier.
    """
    partitions = shuffle_partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunks = max(2 * partitions, size // CHUNK_BYTES)
    parts = max(partitions, size // PART_BYTES)
    bits = min(64, max(16, size.bit_length()) + 12)
    chunked = docs.select("doc_id", "digest", "text", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(chunks)).alias("chunk")).repartition(partitions, "chunk")
    by_chunk = chunked.groupBy("chunk")
    first = answers(by_chunk.applyInArrow(_ask_first(parts, bits, width), ASKED), parts, bits)
    second = answers(by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(_ask_second(parts, bits, width), ASKED), parts)
    cut = by_chunk.cogroup(second.groupBy("chunk")).applyInArrow(_cut(parts, width), _SUFFIXES)
    suffixes = settle(cut.mapInArrow(_merge(width, by_window=False), _MERGED))
    keyed = prefixed(suffixes.where("body is not null").drop("n"), width, tree_bytes)
    windows = keyed.where("key is null").drop("key").mapInArrow(_merge(width, by_window=True), _MERGED)
    rows = keyed.where("key is not null").union(windows.where("body is not null").drop("n").withColumn("key", F.xxhash64(F.lit(-1), "body")))
    grown = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_grow(width), _MARKS)
    late = suffixes.union(windows).where("body is null").select("doc_id", "digest", F.expr("at << 20 | n"))
    marks = settle(grown.union(late))
    discard(suffixes)
    return marks


def substring_dedup(docs: DataFrame, width: int = 20, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space) of every row of docs.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. A word goes when a window of `width` words that covers it also starts earlier:
    in a smaller doc_id, or before in the same document; windows are judged on the input. Null texts and those of
    fewer words lose nothing. A row with a null doc_id loses nothing and owns nothing. Rows that repeat a doc_id and
    its text get the same result, and none is earlier than another; of rows that share a doc_id but not the text the
    one whose text has the smaller 64-bit hash is earlier. No rows give no rows; other columns are not read. A text is
    held whole by one task, with some twenty times its bytes; it must have fewer than 2**43 words.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # a window has at least width characters and the blanks between
    long_enough = F.col("doc_id").isNotNull() & (F.octet_length("text") >= 2 * width - 1)
    texts = rows.where(long_enough).withColumn("digest", F.xxhash64("text"))
    codes = late_windows(texts, width, tree_bytes).groupBy("doc_id", "digest").agg(F.collect_set("code").alias("codes"))
    judged = texts.join(codes.hint("shuffle_hash"), ["doc_id", "digest"], "left").select("doc_id", "text", "codes")
    rest = rows.where(~F.coalesce(long_enough, F.lit(False))).select("doc_id", "text", F.lit(None).cast("array<long>").alias("codes"))
    return judged.union(rest).mapInArrow(_keep(width), "doc_id long, n_words long, n_removed long, kept string")

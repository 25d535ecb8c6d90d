"""Exact deduplication: Patricia tries over whole byte strings, one per partition of length and short content hash.

1. Each task inserts its own texts into the tries of their partitions. A terminal node is given a number; every row is
   put out with the number of its terminal, and a string once with its owner and its rows, however often a task reads
   it. Beyond `budget` bytes the heaviest subtrees are put out and freed: they become rows of the table in the shared folder.
2. The strings meet by partition, sorted, and are inserted again: of equal ones the terminal keeps the owner - the row
   with the most code points before normalisation, then the smallest id - and adds up the rows. In sorted order all but
   the path to the last string is finished, so beyond `budget` the finished subtrees are put out and freed.
3. Rows find their group by the number of their terminal, which only rows of one task share: no key is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from symloom.llm.storage import settle
from symloom.llm.words import SPACE

BUDGET = 24_000_000
#: What a node counts besides its label.
_NODE = 200
_PLACED_NAMES = ["terminal", "row", "doc_id", "n", "part", "body", "chars", "rows"]
_PLACED = StructType([StructField(name, BinaryType() if name == "body" else LongType()) for name in _PLACED_NAMES])
_GROUP = "terminal long, sha binary, keep_id long, keep_row long, group_size long"


class PatriciaTrie:
    """A compressed radix trie of byte strings; a terminal holds [owner, rows, number or numbers]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]  # label, children by first byte, terminal
        self.held = 0

    def insert(self, key: bytes, owner: tuple, rows: int) -> list:
        """The key's terminal; a new one has no numbers yet."""
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = [key[at:], {}, None]
                self.held += len(child[0]) + _NODE
                node[1][key[at]] = child
                node = child
                break
            label = child[0]
            if not key.startswith(label, at):
                shared = _common(label, key, at)
                upper = [label[:shared], {label[shared]: child}, None]
                child[0] = label[shared:]
                node[1][key[at]] = upper
                child = upper
                self.held += _NODE
            node, at = child, at + len(child[0])
        if node[2] is None:
            node[2] = [owner, rows, None]
        else:
            node[2][0] = min(node[2][0], owner)
            node[2][1] += rows
        return node[2]

    def terminals(self, below: tuple[list, bytes] | None = None) -> Iterator[tuple[bytes, list]]:
        """(string, terminal) of all, or of those below a node and what stands above it."""
        stack = [below or (self.root, b"")]
        while stack:
            node, above = stack.pop()
            here = above + node[0]
            if node[2] is not None:
                yield here, node[2]
            stack += [(child, here) for child in node[1].values()]

    def spill(self, last: bytes) -> Iterator[tuple[bytes, list]]:
        """Puts out and frees all subtrees and terminals but those on the path to `last`."""
        node, here, self.held = self.root, b"", 0
        while True:
            here += node[0]
            self.held += len(node[0]) + _NODE
            if node[2] is not None and here != last:
                yield here, node[2]
                node[2] = None
            goes_on = None
            for first, child in list(node[1].items()):
                if len(here) < len(last) and first == last[len(here)]:
                    goes_on = child
                else:
                    yield from self.terminals((child, here))
                    del node[1][first]
            if goes_on is None:
                return
            node = goes_on


def _common(label: bytes, key: bytes, at: int) -> int:
    """How many bytes label and key from at share; they differ within label."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


def _owner(chars: int, doc_id: int | None, row: int) -> tuple:
    return -chars, doc_id is None, doc_id or 0, row


def normalise(text: str | None) -> bytes:
    """The text's UTF-8 bytes without the characters \\x20 and \\x09-\\x0D."""
    return (text or "").encode().translate(None, SPACE)


def short_hash(body: bytes, parts: int) -> int:
    return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "big") % parts


def _place(parts: int, budget: int, keep: list[pa.Field]):
    """From texts: each row with its terminal's number, and each string that a trie lets go of (rows is not null)."""
    schema = pa.schema([*((name, pa.binary() if name == "body" else pa.int64()) for name in _PLACED_NAMES), *keep])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[tuple[int, int], PatriciaTrie] = {}
        number = row = TaskContext.get().partitionId() << 33
        held = 0

        def strings(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 8
            made = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)]
            return pa.RecordBatch.from_arrays([*made, *(pa.nulls(len(rows), f.type) for f in keep)], schema=schema)

        def let_go(least: int) -> Iterator[pa.RecordBatch]:
            """The heaviest tries, subtree by subtree, until no more than `least` bytes are held."""
            nonlocal held
            for key in sorted(tries, key=lambda k: -tries[k].held):
                if held <= least:
                    break
                trie, out, size = tries.pop(key), [], 0
                held -= trie.held
                for body, (owner, rows, terminal) in trie.terminals():
                    out.append((terminal, owner[3], None if owner[1] else owner[2], *key, body, -owner[0], rows))
                    size += len(body)
                    if size > budget:
                        yield strings(out)
                        out, size = [], 0
                yield strings(out)

        for batch in batches:
            members: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                body = normalise(text)
                trie = tries.setdefault((len(body), short_hash(body, parts)), PatriciaTrie())
                before = trie.held
                terminal = trie.insert(body, _owner(len(text), doc_id, row), 1)
                if terminal[2] is None:
                    terminal[2] = number
                    number += 1
                held += trie.held - before
                members.append((terminal[2], row, doc_id))
                row += 1
                if held > budget:
                    yield from let_go(budget // 2)
            made = [pa.array(c, pa.int64()) for c in zip(*members, strict=True)] or [pa.nulls(0, pa.int64())] * 3
            empty = [pa.nulls(len(members), f.type) for f in schema][3 : len(_PLACED_NAMES)]
            yield pa.RecordBatch.from_arrays([*made, *empty, *(batch.column(f.name) for f in keep)], schema=schema)
        yield from let_go(-1)

    return run


def _merge(budget: int):
    """From strings sorted by partition and bytes: the group of every terminal's number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, partition, out = PatriciaTrie(), None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 5
            out.clear()
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["terminal", "sha", "keep_id", "keep_row", "group_size"])

        def put(strings: Iterable[tuple[bytes, list]]) -> None:
            for body, (owner, rows, numbers) in strings:
                sha = hashlib.sha256(body).digest()
                out.extend((k, sha, None if owner[1] else owner[2], owner[3], rows) for k in numbers)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("terminal", "row", "doc_id", "n", "part", "chars", "rows")]
            for number, row, doc_id, n, part, chars, rows, body in zip(*columns, batch.column("body"), strict=True):
                if (n, part) != partition:
                    put(trie.terminals())
                    trie, partition = PatriciaTrie(), (n, part)
                body = body.as_py()
                terminal = trie.insert(body, _owner(chars, doc_id, row), rows)
                terminal[2] = terminal[2] or []
                terminal[2].append(number)
                if trie.held > budget:
                    put(trie.spill(body))
                if len(out) > 20_000:
                    yield flush()
        put(trie.terminals())
        yield flush()

    return run


def exact_dedup(docs: DataFrame, budget: int = BUDGET, parts: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and the columns named in keep.

    Two texts are equal when they are identical without the characters of [\\x20\\x09-\\x0D]. A null text counts as
    empty, and all empty texts are equal. The row with the most code points stays, then the smallest doc_id; a null
    doc_id comes after all others. Exactly one row of a group is kept, also where rows repeat: of rows with the same id
    and number of code points any one. No rows give no rows; other columns of docs are not read. A text must fit in an
    Arrow batch (2 GB). parts is the number of short hashes; if it is None, as many as the bytes of all texts need to
    give a trie no more than `budget`, at least 16.
    """
    carried = [f"keep_{k}" for k in range(len(keep))]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(F.col(c).alias(k) for c, k in zip(keep, carried, strict=True)))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        parts = max(16, size // budget)
    fields = [rows.schema[c] for c in carried]
    schema = StructType([*_PLACED.fields, *(StructField(f.name, f.dataType) for f in fields)])
    placed = settle(rows.mapInArrow(_place(parts, budget, [pa.field(f.name, to_arrow_type(f.dataType)) for f in fields]), schema))
    strings = placed.where("rows is not null").select(*_PLACED_NAMES).repartition("n", "part").sortWithinPartitions("n", "part", "body")
    groups = strings.mapInArrow(_merge(budget), _GROUP)
    members = placed.where("rows is null").select("terminal", "row", "doc_id", *carried)
    return members.join(groups, "terminal").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *(F.col(k).alias(c) for c, k in zip(keep, carried, strict=True)),
    )

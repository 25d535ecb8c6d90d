"""Token counts of byte-level BPE vocabularies: the exact count at every prefix of every text.

A text is cut into units - a run of white space and the piece after it - whose counts depend on nothing outside. Each
unit's prefix counts come from dynamic programming (see bpe.py) and are remembered, so a text's table is the joined
tables of its units. Stored are the steps from one prefix to the next, one signed byte per character.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.bpe import Memo, PrefixBpe

#: The endings that the vocabulary's own splitting pattern sets apart.
_ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_ENDING = "'(?:[stmd]|re|ve|ll)"
_MARKS = r"[^\s\p{L}\p{N}]+"
_UNIT = regex.compile(rf"{_ENDING}|\s*\p{{L}}+|\s*\p{{N}}+|(?:\s* )?{_MARKS}|\s*[^\S ](?:{_ENDING}|{_MARKS})|\s+")
_BLANK = regex.compile(r"\s*")


def _byte_alphabet() -> list[str]:
    """The character that stands for each byte in the vocabulary file: itself if it is visible, else the next from 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


class PrefixCounter:
    """Prefix counts under one vocabulary file (the JSON of a byte-level BPE tokenizer)."""

    def __init__(self, vocabulary: bytes) -> None:
        spec = json.loads(vocabulary)
        splitter = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without normalizer and prefix space is needed")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ranks = {(a, b): k for k, (a, b) in enumerate(pairs)}
        alphabet = _byte_alphabet()
        self.bpe = PrefixBpe([*alphabet, *dict.fromkeys(a + b for a, b in pairs)], lambda a, b: ranks.get((a, b)))
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(alphabet)})
        self.space = alphabet[32]
        self.units = Memo(self._unit_steps)
        special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def _piece(self, piece: str) -> list[int]:
        """The counts at the ends of the piece's characters."""
        data = piece.encode()
        if len(data) == len(piece):
            return self.bpe.counts(piece.replace(" ", self.space) if piece.isprintable() else piece.translate(self.letters))[1:]
        counts = self.bpe.counts(data.decode("latin-1").translate(self.letters))
        ends = np.cumsum([len(c.encode()) for c in piece])
        return [counts[e] for e in ends]

    def _unit_steps(self, unit: str) -> bytes:
        blank = _BLANK.match(unit).end()
        core, counts = unit[blank:], []
        if core not in _ENDINGS and (not blank or (blank == 1 and unit[0] == " ")):
            counts = self._piece(unit)
        elif blank:
            counts = self._piece(unit[:blank])
        if core and len(counts) < len(unit):
            before, skip = 0, 0
            if blank > 1:
                before = counts[blank - 2]
            if blank and unit[blank - 1] == " ":
                core, skip = f" {core}", 1
            elif blank:
                before += self._piece(unit[blank - 1])[-1]
            inner = self._piece(core)
            if core in _ENDINGS and len(core) == 3:  # cut short, it is a mark and a letter
                inner[1] = self._piece(core[0])[-1] + self._piece(core[1])[-1]
            counts += [before + c for c in inner[skip:]]
        return bytes([(here - before) & 255 for before, here in pairwise([0, *counts])])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.units.__getitem__, _UNIT.findall(text)))

    def steps(self, text: str) -> bytes:
        """A signed byte for each character: by how much it changes the count of the prefix that it ends."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out, at = [], 0
        for found in self.special.finditer(text):
            total = np.frombuffer(self._plain(text[at : found.start()]), np.int8).sum(dtype=np.int64)
            steps = np.frombuffer(self._plain(text[at : found.end()]), np.int8).copy()  # cut short, it is no token
            steps[-1] = total + 1 - steps[:-1].sum(dtype=np.int64)
            out.append(steps.tobytes())
            at = found.end()
        return b"".join(out) + self._plain(text[at:])


_counters: dict[bytes, PrefixCounter] = {}


def counter(vocabulary: bytes) -> PrefixCounter:
    """One for each process."""
    key = hashlib.sha256(vocabulary).digest()
    if key not in _counters:
        _counters.clear()
        _counters[key] = PrefixCounter(vocabulary)
    return _counters[key]


def prefix_counts(steps: bytes) -> np.ndarray:
    """The number of tokens of each prefix, from the empty one to the whole text."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)])


def longest_prefix(steps: bytes, budget: int) -> int:
    """The characters of the longest prefix with at most `budget` tokens; -1 if there is none."""
    within = np.flatnonzero(prefix_counts(steps) <= budget)
    return int(within[-1]) if len(within) else -1


def token_prefixes(docs: DataFrame, vocabulary: str | Path) -> DataFrame:
    """doc_id, n_bytes, n_tokens, prefix_steps of every row of docs.

    vocabulary is the path of the file where this is called; its bytes (a few MB) go with the tasks. Tokens are those
    that the file's library gives: special strings in a text are special tokens, none are added. prefix_steps answers
    prefix_counts() and longest_prefix() without the text. A null text counts as empty: 0 bytes, 0 tokens, no steps.
    Null ids and repeated rows are passed through row by row; no rows give no rows; other columns are not read.
    """
    data = Path(vocabulary).read_bytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(data)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            steps = [known.steps(t) for t in texts]
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            tokens = [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(steps, pa.binary())], ["doc_id", "n_bytes", "n_tokens", "prefix_steps"])
        known.units.clear()  # an idle worker holds no memory of its last task
        known.bpe.beside.clear()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, prefix_steps binary")


def token_counts(docs: DataFrame, vocabulary: str | Path, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every row: see token_prefixes."""
    table = token_prefixes(docs, vocabulary)
    return table.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""Asking the whole corpus about sets of 64-bit keys, a sorted block at a time.

A chunk (some documents) asks about its distinct keys; the keys are dealt into ranges of the key space, every range
looks at the blocks of all chunks and answers each with two bits a key: does it occur more than once, and are there two
different notes on it. A key that a chunk has a million times is asked about once, so no key is hot. Keys are sorted and
sent as differences in as few bytes as the largest of a block needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ASKED = "part long, chunk long, size long, step long, deltas binary, flags binary, notes binary"
ANSWERED = "part long, chunk long, bits binary"
_NAMES = ["part", "chunk", "size", "step", "deltas", "flags", "notes"]
_TYPES = [pa.int64()] * 4 + [pa.binary()] * 3
ANSWER_TYPES = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("bits", pa.binary())])
_NOTE_BYTES = 6


def _planes(values: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of each value, all first bytes first."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _unplaned(data: bytes, size: int, count: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(size, count).T
    return out.view("<u8").ravel().astype(np.uint64)


def _bounds(keys: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Where each range begins in sorted keys of `bits` bits."""
    lows = np.array([-(-(k << bits) // parts) for k in range(parts)], np.uint64)
    return np.append(np.searchsorted(keys, lows), len(keys))


def ask(chunk: int, keys: np.ndarray, flags: np.ndarray, notes: np.ndarray | None, parts: int, bits: int = 64) -> pa.Table:
    """Blocks of a chunk's sorted distinct keys; flags: 1 more than once in the chunk, 2 with different notes."""
    rows = []
    cuts = _bounds(keys, parts, bits)
    for part in range(parts):
        a, b = int(cuts[part]), int(cuts[part + 1])
        if a == b:
            continue
        deltas = np.diff(keys[a:b], prepend=keys[a])
        deltas[0] = keys[a] - np.uint64(-(-(part << bits) // parts))
        step = max(1, (int(deltas.max()).bit_length() + 7) // 8)
        both = np.concatenate([flags[a:b] & 1, flags[a:b] >> 1])
        rows.append((part, chunk, b - a, step, _planes(deltas, step), np.packbits(both).tobytes(), b"" if notes is None else _planes(notes[a:b], _NOTE_BYTES)))
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.table([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def passed(chunk: int, bits: bytes) -> pa.Table:
    """A block that comes back as it is: its range is negative."""
    return pa.table([pa.array([v], t) for v, t in zip((-1 - chunk, chunk, 0, 1, bits, b"", b""), _TYPES, strict=True)], names=_NAMES)


def _answer(parts: int, bits: int):
    def run(blocks: pa.Table) -> pa.Table:
        part = blocks.column("part")[0].as_py()
        chunks, sizes, steps = (blocks.column(c).to_numpy() for c in ("chunk", "size", "step"))
        if part < 0:
            return pa.table([blocks.column("part"), blocks.column("chunk"), blocks.column("deltas")], schema=ANSWER_TYPES)
        base = np.uint64(-(-(part << bits) // parts))
        keys, flags, notes = [], [], []
        for size, step, deltas, flag, note in zip(sizes.tolist(), steps.tolist(), *(blocks.column(c) for c in ("deltas", "flags", "notes")), strict=True):
            keys.append(np.cumsum(_unplaned(deltas.as_py(), step, size), dtype=np.uint64) + base)
            flags.append(np.unpackbits(np.frombuffer(flag.as_py(), np.uint8), count=2 * size).reshape(2, size))
            data = note.as_py()
            notes.append(_unplaned(data, _NOTE_BYTES, size) if data else np.zeros(size, np.uint64))
        keys, flags, notes = np.concatenate(keys), np.concatenate(flags, axis=1), np.concatenate(notes)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        runs = np.diff(np.append(heads, len(keys)))
        often = (runs > 1) | np.maximum.reduceat(flags[0][order], heads).astype(bool)
        noted = notes[order]
        varied = np.maximum.reduceat(flags[1][order], heads).astype(bool) | (np.minimum.reduceat(noted, heads) != np.maximum.reduceat(noted, heads))
        told = np.zeros((2, len(keys)), np.uint8)
        told[0][order] = np.repeat(often, runs)
        told[1][order] = np.repeat(varied, runs)
        ends = np.cumsum(sizes)
        out = [np.packbits(told[:, e - s : e]).tobytes() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        return pa.table([pa.array(np.full(len(out), part)), pa.array(chunks), pa.array(out, pa.binary())], schema=ANSWER_TYPES)

    return run


def answers(asked: DataFrame, parts: int, bits: int = 64) -> DataFrame:
    """(part, chunk, bits): the answer to each block."""
    return asked.groupBy("part").applyInArrow(_answer(parts, bits), ANSWERED)


def read_answers(keys: np.ndarray, told: Iterator[tuple[int, bytes]], parts: int, bits: int = 64) -> np.ndarray:
    """Two rows of booleans over a chunk's sorted distinct keys: more than once, with different notes."""
    cuts = _bounds(keys, parts, bits)
    out = np.zeros((2, len(keys)), bool)
    for part, data in told:
        a, b = int(cuts[part]), int(cuts[part + 1])
        out[:, a:b] = np.unpackbits(np.frombuffer(data, np.uint8), count=2 * (b - a)).reshape(2, b - a)
    return out

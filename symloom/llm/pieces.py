"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

At each position the output links list all pieces that end there, and the best way to it is relaxed. For a unigram
model the best way is that of the highest total score. For a BPE model scores are merge priorities, and their sums say
nothing; there the only admissible way is the one that merging itself takes, which pairs of neighbours decide (bpe.py).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.llm.bpe import Memo, PrefixBpe, merge

_SPACE = "▁"
_UNIT = re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+")
#: The kinds of pieces and models in a model file.
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_UNIGRAM, _BPE = 1, 2
#: What a character without a piece costs below the lowest score.
_UNKNOWN_COST = 10.0


class Viterbi:
    """Unigram models: the segmentation of the highest total score."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.strange = min(scores.values()) - _UNKNOWN_COST

    def encode(self, text: str) -> list[str]:
        best = [0.0] + [-np.inf] * len(text)
        back = [0] * (len(text) + 1)
        done = 0

        def close(until: int) -> None:  # no piece needs to end at a position: one character can always be taken alone
            nonlocal done
            while done < until:
                done += 1
                if best[done - 1] + self.strange > best[done]:
                    best[done], back[done] = best[done - 1] + self.strange, done - 1

        for end, (length, score) in self.automaton.iter(text):
            close(end)
            start, here = end + 1 - length, end + 1
            if best[start] + score > best[here]:
                best[here], back[here] = best[start] + score, start
        close(len(text))
        out, at = [], len(text)
        while at:
            out.append(text[back[at] : at])
            at = back[at]
        return out[::-1]


class PieceCodec:
    """Encoding and decoding under one model file."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        rules = spec.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a model that changes no characters is needed")
        self.prefix = _SPACE if rules.add_dummy_prefix else ""
        plain = {p.piece: p.score for p in spec.pieces if p.type in (_NORMAL, _USER)}
        self.ids = {p.piece: k for k, p in enumerate(spec.pieces)}
        self.bytes = {int(p.piece[1:-1], 16): k for k, p in enumerate(spec.pieces) if p.type == _BYTE}
        self.unknown = next(k for k, p in enumerate(spec.pieces) if p.type == _UNKNOWN)
        surface = spec.trainer_spec.unk_surface.encode()
        self.surfaces = [p.piece.replace(_SPACE, " ").encode() if p.type in (_NORMAL, _USER) else bytes([int(p.piece[1:-1], 16)]) if p.type == _BYTE else surface if p.type == _UNKNOWN else b"" for p in spec.pieces]
        if spec.trainer_spec.model_type == _UNIGRAM:
            self.engine: Viterbi | PrefixBpe = Viterbi(plain)
        elif spec.trainer_spec.model_type == _BPE:

            def rank(a: str, b: str) -> float | None:
                score = plain.get(a + b)
                return None if score is None else -score

            self.engine = PrefixBpe([p for p in plain if merge(list(p), rank) == [p]], rank)
        else:
            raise ValueError("a unigram or BPE model is needed")
        #: Without pieces that go on after a word's end, words can be encoded one by one.
        self.by_word = isinstance(self.engine, PrefixBpe) and not any(_SPACE in p.lstrip(_SPACE) for p in plain)
        self.units = Memo(self._unit)

    def _unit(self, unit: str) -> bytes:
        out: list[int] = []
        for piece in self.engine.encode(unit):
            if (k := self.ids.get(piece)) is not None:
                out.append(k)
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return np.array(out, np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        text = self.prefix + text.replace(" ", _SPACE)
        data = b"".join(map(self.units.__getitem__, _UNIT.findall(text))) if self.by_word else self._unit(text)
        return np.frombuffer(data, np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.surfaces.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_codecs: dict[bytes, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """One for each process."""
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = PieceCodec(model)
    return _codecs[key]


def encode_pieces(docs: DataFrame, model: str | Path, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, ids (array<int>) of every row of docs, as the model's library gives them without added pieces.

    Columns named in keep are carried along.

    model is the path of the file where this is called; its bytes (under a few MB) go with the tasks. A null text
    stays null and has no ids, as an empty one. Characters without a piece become byte pieces, or the unknown piece if
    the model has none. Null ids of documents and repeated rows are passed through; no rows give no rows; other
    columns are not read.
    """
    data = Path(model).read_bytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(data)
        for batch in batches:
            ids = [known.encode(t or "") for t in batch.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, np.concatenate(ids) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "ids"])
        known.units.clear()  # an idle worker holds no memory of its last task
        if isinstance(known.engine, PrefixBpe):
            known.engine.beside.clear()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_pieces(encoded: DataFrame, model: str | Path) -> DataFrame:
    """The rows of `encoded` (doc_id, text, ids) with the column decoded: the text of the ids.

    It equals the text that was encoded, but for the character U+2581, which becomes a space. Null ids give an empty
    text.
    """
    data = Path(model).read_bytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(data)
        for batch in batches:
            ids = batch.column("ids")
            decoded = [known.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else "" for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.string())], [*batch.schema.names, "decoded"])

    rows = encoded.select("doc_id", "text", "ids")
    return rows.mapInArrow(run, "doc_id long, text string, ids array<int>, decoded string")

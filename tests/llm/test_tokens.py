from __future__ import annotations

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from symloom.llm.bpe import PrefixBpe, merge
from symloom.llm.pieces import Viterbi, codec, decode_pieces, encode_pieces
from symloom.llm.token_counts import counter, longest_prefix, prefix_counts, token_counts, token_prefixes

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [*"abcXYZ  \n\n\t\r'''stremvld.,!?-019éß漢🎉▁ \x1c\x85", "<|endoftext|>", "'ll", "the ", "!!!!", "        "]


def texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(n)] + ["", "a" * 5000, " " * 3000 + "x", "Donaudampfschiff" * 50]


def test_counts_at_every_prefix():
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(BYTES)
    ours = counter(open(BYTES, "rb").read())
    for text in texts(400)[:-3]:
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert prefix_counts(ours.steps(text)).tolist() == want


def test_budgets_from_the_table():
    steps = counter(open(BYTES, "rb").read()).steps("one two three four")
    counts = prefix_counts(steps)
    for budget in range(-1, 6):
        fits = [k for k, c in enumerate(counts) if c <= budget]
        assert longest_prefix(steps, budget) == (fits[-1] if fits else -1)


def test_token_counts_of_a_table(spark):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(BYTES)
    rows = [(k, t) for k, t in enumerate(texts(50))] + [(None, "x y"), (3, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    got = token_counts(docs, BYTES, limit=20).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 20) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_prefixes(docs.limit(0), BYTES).count() == 0


def test_pieces_as_the_library(spark):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PIECES)
    rows = [(k, t) for k, t in enumerate(texts(300))] + [(None, "x y"), (3, None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    got = decode_pieces(encode_pieces(docs, PIECES), PIECES).collect()
    assert sorted((str(r.doc_id), r.text or "", list(r.ids)) for r in got) == sorted((str(i), t or "", library.encode(t or "")) for i, t in rows)
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in got)
    assert encode_pieces(docs.limit(0), PIECES).count() == 0


def test_decoding_odd_ids():
    ours = codec(open(PIECES, "rb").read())
    assert ours.decode([]) == ""
    assert ours.decode([1, 2]) == ""
    assert ours.decode([3 + 0xFF]) == "�"


def test_prefix_dynamic_programming_is_merging():
    rng = random.Random(4)
    for _ in range(60):
        ranks, tokens = {}, list("abc")
        for k in range(12):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens and len(a + b) < 7:
                ranks[a, b] = k
                tokens.append(a + b)
        rank = lambda a, b, ranks=ranks: ranks.get((a, b))
        ours = PrefixBpe([t for t in tokens if merge(list(t), rank) == [t]], rank)
        for _ in range(40):
            text = "".join(rng.choice("abc") for _ in range(rng.randrange(14)))
            assert ours.encode(text) == merge(list(text), rank)
            assert ours.counts(text) == [len(merge(list(text[:k]), rank)) for k in range(len(text) + 1)]


def test_viterbi_finds_the_best_segmentation():
    rng = random.Random(5)
    for _ in range(40):
        scores = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))): -rng.randrange(1, 60) / 7 for _ in range(5)}
        ours = Viterbi(scores)
        cost = lambda pieces, scores=scores, ours=ours: sum(scores.get(p, ours.strange) for p in pieces)

        def ways(text):
            return [[]] if not text else [[text[:k], *rest] for k in range(1, len(text) + 1) if k == 1 or text[:k] in scores for rest in ways(text[k:])]  # noqa: B023

        for _ in range(10):
            text = "".join(rng.choice("abc") for _ in range(rng.randrange(8)))
            got = ours.encode(text)
            assert "".join(got) == text
            assert cost(got) == pytest.approx(max(map(cost, ways(text))))

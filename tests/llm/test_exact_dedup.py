from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from symloom.llm.exact_dedup import PatriciaTrie, exact_dedup, normalise

DOCS = "doc_id long, text string, keep_id string, terminal string"


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(normalise(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return sorted(((doc_id, min(g := groups[normalise(text)])[3], len(g), hashlib.sha256(normalise(text)).hexdigest()) for doc_id, text in rows), key=str)


# with one short hash all strings of a length share a trie; 300 bytes are less than any partition
@pytest.mark.parametrize(("budget", "parts"), [(24_000_000, None), (24_000_000, 1), (300, 1), (300, 7)])
def test_against_brute_force(spark, budget, parts):
    rng = random.Random(1)
    texts = ["", None, " ", "a b", "ab", "a\tb ", "ba", "b a", "é", "e", "abc" * 2000, "abc" * 2000 + "d"]
    texts += ["x" * k + rng.choice("yz") + "x" * (20 - k) for k in range(20)]
    rows = [(k if k % 9 else None, rng.choice(texts)) for k in range(400)] + [(7, "ab"), (7, "ab"), (-3, "ba"), (None, "only"), (None, "only")]
    got = exact_dedup(spark.createDataFrame([(*r, "clash", "t") for r in rows], DOCS).repartition(3), budget, parts, keep=("keep_id", "text")).toPandas()
    assert list(got.columns) == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "keep_id", "text"]
    found = [tuple(None if x != x else x for x in r) for r in got.itertuples(index=False, name=None)]
    assert sorted(((r[0] if r[0] is None else int(r[0]), r[1] if r[1] is None else int(r[1]), r[2], r[4]) for r in found), key=str) == brute(rows)
    # one row of each group is kept: one that has the kept id and the most characters
    kept = [r for r in found if r[3]]
    assert Counter(r[4] for r in kept) == Counter({r[4] for r in found})
    most = {}
    for r in found:
        most[r[4]] = max(most.get(r[4], 0), len(r[6] or ""))
    assert all(r[0] == r[1] and len(r[6] or "") == most[r[4]] and r[5] == "clash" for r in kept)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_trie_keeps_whole_strings():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))).encode() for _ in range(500)]
    trie = PatriciaTrie()
    for k, w in enumerate(words):
        trie.insert(w, (k,), 1)
    assert sorted((w, t[0][0], t[1]) for w, t in trie.terminals()) == sorted({(w, words.index(w), words.count(w)) for w in words})
    # no node but the root has one child and no string
    stack = list(trie.root[1].values())
    while stack:
        _, below, terminal = stack.pop()
        assert terminal is not None or len(below) > 1
        stack += below.values()


def test_spilled_subtrees_and_the_path_that_stays_are_the_whole_trie():
    rng = random.Random(5)
    words = sorted("".join(rng.choice("abc") for _ in range(rng.randrange(9))).encode() for _ in range(400))
    trie, seen = PatriciaTrie(), []
    for k, w in enumerate(words):
        trie.insert(w, (k,), 1)
        if k % 7 == 0:
            seen += [(x, t[0][0], t[1]) for x, t in trie.spill(w)]
            assert [x for x, _ in trie.terminals()] == [w]
    seen += [(x, t[0][0], t[1]) for x, t in trie.terminals()]
    assert sorted(seen) == sorted({(w, words.index(w), words.count(w)) for w in words})

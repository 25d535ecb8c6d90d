from __future__ import annotations

import random
import re

import numpy as np

from symloom.llm.components import components
from symloom.llm.near_dedup import BLOCK, _strays, estimate, minima, near_duplicates, pack, shingle_set

DOCS = "doc_id long, text string, component string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, width=5):
    w = words(text)
    return {tuple(w[k : k + min(width, len(w))]) for k in range(len(w) - min(width, len(w)) + 1)} if w else set()


def brute(rows, percent):
    ids = sorted({i for i, _ in rows if i is not None})
    sets = {i: shingles(t) for i, t in rows if i is not None}
    label = {i: i for i in ids}
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]]
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return sorted(((i, len(shingles(t)), label.get(i), i == label.get(i)) for i, t in rows), key=str)


def corpus(seed=6):
    rng = random.Random(seed)
    vocabulary = [f"W{k}é" if k % 3 else f"w{k}" for k in range(400)]
    rows = []
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 30, 120]))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, rng.choice([" ", "\n", "  "]).join(copy)))
    return rows + [(5000, ""), (5001, None), (5002, " \t"), (None, "a b c d e f"), (None, None), (5003, "A B c"), (5004, "a b C"), (5005, "x " * 4000), rows[0]]


def test_against_brute_force(spark):
    for percent in (80, 85):
        rows = corpus()
        got = near_duplicates(spark.createDataFrame([(*r, "clash") for r in rows], DOCS).repartition(3), percent).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, percent)


def test_a_large_family_needs_no_pairs(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = [(900, " ".join(base))]
    for k in range(700):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 85)


def test_related_members_of_a_family_are_not_paired(spark, monkeypatch):
    from symloom.llm import near_dedup

    rng = random.Random(10)
    base = [f"w{k}" for k in range(150)]
    rows = [(900, " ".join(base))]
    for k in range(240):  # three changes leave a similarity of about 0.81 to the origin, four 0.75; 0.6 to each other
        copy = list(base)
        for at in rng.sample(range(5, 145), 3 + k % 2):
            copy[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    settle, pairs = near_dedup.settle, []
    monkeypatch.setattr(near_dedup, "settle", lambda df: (pairs.append(settle(df)), pairs[-1])[1] if "partners" in df.columns else settle(df))
    monkeypatch.setattr(near_dedup, "discard", lambda *tables: None)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 80)
    assert 0 < sum(len(r.partners or ()) for r in pairs[0].collect()) < 1500


def test_one_stray_in_a_large_family(spark):
    family = spark.range(20_000).selectExpr("'k' AS key", "id AS doc", "0L AS component")
    stray = spark.createDataFrame([("k", 30_000, 30_000), ("plain", 1, 0), ("plain", 2, 0)], "key string, doc long, component long")
    got = _strays(family.union(stray)).collect()
    blocks = -(-20_000 // BLOCK)
    assert len(got) == 20_000 + blocks + 1 and {r.key for r in got} == {"k"}
    # the stray meets each block of the family, and each member of it meets the stray once
    assert {(r.bi, r.bj) for r in got if r.doc == 30_000} == {(0, 0)} | {(0, -1 - k) for k in range(blocks)}
    assert all(r.bi == 0 and r.bj < 0 and r.side == 1 for r in got if r.doc < 20_000)


def test_strays_meet_each_other_and_the_largest_component(spark):
    rows = [("k", d, d % 3 if d % 4 else 9) for d in range(60)]
    got = _strays(spark.createDataFrame(rows, "key string, doc long, component long"), block=5).collect()
    label = {d: c for _, d, c in rows}
    sizes = {c: list(label.values()).count(c) for c in set(label.values())}
    largest = max(sizes, key=lambda c: (sizes[c], c))
    met = set()
    for a in got:
        for b in got:
            if (a.bi, a.bj) == (b.bi, b.bj) and (a.bi == a.bj or a.side != b.side) and a.doc < b.doc:
                met.add((a.doc, b.doc))
    need = {(a, b) for a in label for b in label if a < b and label[a] != label[b]}
    assert need <= met and not any(label[a] == label[b] == largest for a, b in met)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_estimates_follow_similarity():
    rng = np.random.default_rng(9)
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        cut = int(2000 * share)
        other = np.concatenate([both[:cut], rng.integers(0, 2**63, 2000 - cut, dtype=np.uint64)])
        exact = cut / (4000 - cut)
        a, b = (np.frombuffer(pack(minima(np.unique(s))), np.uint64)[None, :] for s in (both, other))
        assert abs(estimate(a, b)[0, 0] - exact) < 0.16


def test_shingles_by_words():
    assert len(shingle_set("A b  c\td e f")) == len(shingles("A b  c\td e f")) == 2
    assert (shingle_set("A b c") == shingle_set("a  B c")).all() and not len(shingle_set(None))


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (200, 200), (41, 39)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(42)} | {100: 100, 101: 100, 103: 100, 200: 200}

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from symloom.llm.decontaminate import decontaminate
from symloom.llm.perplexity import HELD_OUT, ORDER, classify, grams, score, train
from symloom.llm.sharding import kd_shards

DOCS = "doc_id long, text string, lang string, source string, n_hit string"


# ---- decontamination


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    windows = defaultdict(set)
    for i, t in items:
        w = tokens(t)
        n = min(window, len(w))
        if i is not None and n:
            for s in range(len(w) - n + 1):
                windows[tuple(w[s : s + n])].add(str(i))
    sizes, out = {len(w) for w in windows}, []
    for i, t in docs:
        w, hit, ids = tokens(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    ids |= found
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_decontamination_against_brute_force(spark, broadcast_rows):
    rng = random.Random(13)
    vocabulary = ["the", "of", "The", "école", "École", "x9", *[f"w{k}" for k in range(25)]]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 25])))) for k in range(25)]
    items += [(100, None), (101, " ... "), (None, "w1 w2 w3"), (3, items[3][1]), (102, "the the the the the the the the the the the the")]
    docs = []
    for k in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text[at:at] = (rng.choice(items)[1] or "").split()[: rng.choice([9, 10, 99])]
        docs.append((k, rng.choice([" ", "-", "\n. "]).join(text)))
    docs += [(None, items[6][1]), (None, items[7][1]), (70, None), (71, ""), (72, "the " * 200), docs[0], (5, items[8][1]), (5, "plain words"), (73, "w1 " * 30_000 + (items[9][1] or ""))]
    got = decontaminate(spark.createDataFrame([(*d, "en", "s", "clash") for d in docs], DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=broadcast_rows).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "en", "s", "x")], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate(docs, items).collect()] == [(1, 2, 0, 0)]
    assert decontaminate(docs.limit(0), items).count() == 0


# ---- perplexity


def discounts(counts):
    n1, n2, n3, n4 = (sum(c == k for c in counts.values()) for k in (1, 2, 3, 4))
    if not min(n1, n2, n3, n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


class Reference:
    """Interpolated modified Kneser-Ney by its definition."""

    def __init__(self, texts):
        self.counts = {ORDER: Counter()}
        for t in texts:
            t = t.encode()
            padded = b"\0" * (ORDER - 1) + t
            self.counts[ORDER].update(padded[k : k + ORDER] for k in range(len(t)))
        for n in range(ORDER - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.cuts = {n: discounts(c) for n, c in self.counts.items()}

    def p(self, gram):
        n = len(gram)
        own = {g: c for g, c in self.counts[n].items() if g[:-1] == gram[:-1]}
        below = 1 / (len(self.counts[1]) + 1) if n == 1 else self.p(gram[1:])
        if not own:
            return below
        cut = lambda c: self.cuts[n][min(c, 3) - 1]
        freed = sum(map(cut, own.values())) / sum(own.values())
        c = own.get(gram, 0)
        return (c - cut(c) if c else 0) / sum(own.values()) + freed * below

    def log_sum(self, text):
        data = (text or "").encode()
        padded = b"\0" * (ORDER - 1) + data
        return sum(math.log(self.p(padded[k : k + ORDER])) for k in range(len(data)))


def test_scores_against_the_definition_on_both_paths(spark):
    rng = random.Random(14)
    texts = ["".join(rng.choice("abcé  ") for _ in range(rng.randrange(40))) for _ in range(60)]
    model = train(spark.createDataFrame([(t,) for t in texts[:40]] + [(None,)], "text string"))
    rows = [(k, t, "en", "s", "x") for k, t in enumerate([*texts, "zzz", "", None, "a" * 3000])]
    want = {k: Reference(texts[:40]).log_sum(t) for k, t, *_ in rows[-14:]}
    for limit in (10**6, 0):
        got = {r.doc_id: r.log_sum for r in score(spark.createDataFrame(rows, DOCS), model, limit).collect()}
        assert len(got) == len(rows)
        for k, v in want.items():
            assert got[k] == pytest.approx(v, abs=1e-6)


def test_large_models_are_scored_shard_by_shard(spark, monkeypatch):
    from symloom.llm import perplexity

    rng = random.Random(20)
    texts = ["".join(rng.choice("abcdé ☃") for _ in range(rng.randrange(60))) for _ in range(80)]
    model = train(spark.createDataFrame([(t,) for t in texts[:60]], "text string"))
    docs = spark.createDataFrame([(k, t, "en", "s", "x") for k, t in enumerate([*texts, "zzz", "", None, "ab" * 2000])], DOCS)
    want = {r.doc_id: (r.n_chars, pytest.approx(r.log_sum, abs=1e-6)) for r in score(docs, model).collect()}
    monkeypatch.setattr(perplexity, "_HELD", 500)
    monkeypatch.setattr(perplexity, "SHARD_ROWS", 1 + model.rows() // 4)
    cuts = perplexity._cuts(model, perplexity.SHARD_ROWS)
    assert len(cuts) > 3 and cuts[-1] == perplexity.PAIRS
    # each n-gram of the higher orders is in one shard
    shards = [perplexity._shard(model, a, b) for a, b in zip(cuts, cuts[1:])]
    assert all(sum(len(s[0][n][0]) for s in shards) == model.tables[n].count() for n in range(3, 7))
    plans = []
    monkeypatch.setattr(perplexity, "settle", lambda df: plans.append(df._jdf.queryExecution().toString()) or df)
    assert {r.doc_id: (r.n_chars, r.log_sum) for r in score(docs, model, 0).collect()} == want
    # documents are not moved: their n-grams, many times the text, stay in the task
    assert len(plans) == 1 and not any("Exchange" in p for p in plans)


def test_noise_is_rejected_and_text_is_kept(spark):
    rng = random.Random(15)
    lexicon = ["".join(rng.choice(["ta", "ke", "mi", "so", "ru"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    clean = [" ".join(rng.choice(lexicon) for _ in range(rng.randrange(5, 60))) for _ in range(200)]
    noise = ["".join(rng.choice("#$%&*XQZJ0123 ") for _ in range(200)) for _ in range(40)]
    rows = [(k, t, ["en", None][k % 2], "s", "x") for k, t in enumerate(clean + noise)] + [(None, clean[0], "xx", "s", "x"), (900, "", "en", "s", "x"), (901, None, "en", "s", "x"), (0, clean[0], "en", "s", "x")]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 150)] + [(k, 0, 0) for k in range(200, 220)] + [(0, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = classify(spark.createDataFrame(rows, DOCS), labels).collect()
    kept = {r.doc_id: r.kept for r in got if r.doc_id is not None}
    assert len(got) == len(rows)
    assert not any(kept[k] for k in range(200, 240)) and not kept[900] and not kept[901]
    assert sum(kept[k] for k in range(150, 200)) >= 49  # held out
    nobody = classify(spark.createDataFrame(rows, DOCS), labels.where("false")).collect()
    assert all(r.kept for r in nobody if r.n_chars)
    assert classify(spark.createDataFrame([], DOCS), labels).count() == 0


def test_languages_without_trusted_documents_are_not_judged(spark):
    rng = random.Random(16)
    say = lambda sounds: " ".join("".join(rng.choice(sounds) for _ in range(3)) for _ in range(30))
    rows = [(k, say(["ta", "ke", "mi"]), "en", "s", "x") for k in range(60)] + [(k, say(["woj", "bru", "xyl"]), "zz", "s", "x") for k in range(60, 80)] + [(80, "", "zz", "s", "x"), (81, say(["#", "&", "Q"]), "en", "s", "x")]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classify(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert all(got[k].kept and got[k].threshold is None for k in range(60, 80))
    assert not got[80].kept and not got[81].kept and got[0].threshold > 1


def test_toxic_documents_are_not_trusted(spark):
    rng = random.Random(17)
    say = lambda sounds: " ".join("".join(rng.choice(sounds) for _ in range(3)) for _ in range(30))
    rows = [(k, say(["ta", "ke", "mi"]), "en", "s", "x") for k in range(60)] + [(k, say(["woj", "bru", "xyl"]), "en", "s", "x") for k in range(60, 80)]
    marks = [(k, 1, [0, None][k % 2]) for k in range(50)] + [(k, 1, 1) for k in range(60, 70)] + [(k, 1, 0) for k in range(70, 80)] + [(k, 0, 1) for k in range(70, 80)]
    got = {r.doc_id: r.kept for r in classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[k] for k in range(50)) and not any(got[k] for k in range(60, 80))


def test_grams_end_at_each_byte():
    assert len(grams("ab☃")) == 5 and grams("").size == 0
    assert grams("xab")[-1] & ((1 << 16) - 1) == grams("yab")[-1] & ((1 << 16) - 1)
    # characters that differ are different n-grams in every script
    assert len({int(grams(chr(c))[-1]) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000}) == 0x10000 - 1 - 0x800


def test_characters_of_large_scripts_are_told_apart(spark):
    model = train(spark.createDataFrame([("\u4e2d" * 40,), ("\u6587\u4e2d" * 20,)], "text string"))
    rows = [(1, "\u4e2d" * 30, "zh", "s", "x"), (2, "\u562d" * 30, "zh", "s", "x")]
    got = {r.doc_id: r.log_sum for r in score(spark.createDataFrame(rows, DOCS), model).collect()}
    assert got[1] > got[2] + 20


def test_thresholds_and_verdicts_against_brute_force(spark):
    rng = random.Random(18)
    lexicon = ["".join(rng.choice(["ta", "ke", "mi", "so", "ru"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    rows = [(k, " ".join(rng.choice(lexicon) if rng.random() < 0.9 else rng.choice(["Q#", "%%"]) for _ in range(rng.randrange(2, 40))), ["en", "de", None][k % 3], "s", "x") for k in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(k % 4 > 0), int(k % 10 == 0)) for k in range(250)], "doc_id long, quality int, toxic int")
    got = classify(docs, labels, quantile=0.2, margin=1.0, slack=0.1, keep=("source", "n_hit", "doc_id")).toPandas()
    assert list(got.columns) == ["doc_id", "lang", "n_chars", "perplexity", "threshold", "kept", "source", "n_hit", "doc_id"]
    got = {r[0]: r for r in got.itertuples(index=False, name=None)}
    apart = {r.doc_id for r in docs.selectExpr("doc_id", f"pmod(xxhash64(text), {HELD_OUT}) = 0 AS apart").where("apart").collect()}
    trusted = {k for k in range(250) if k % 4 > 0 and k % 10}
    reference = Reference([t for k, t, *_ in rows if k in trusted - apart])
    for k, t, *_ in rows[::40]:
        assert got[k][3] == pytest.approx(math.exp(-reference.log_sum(t) / len(t)), rel=1e-6)
    for tongue in ("en", "de", None):
        mine = [r for r in got.values() if r[1] == tongue]
        reached = sorted(r[3] for r in mine if r[0] in trusted & apart)
        want = reached[max(0, math.ceil(0.2 * len(reached)) - 1)]
        assert {r[4] for r in mine} == {want}
        # one document is exactly at the threshold, and is kept
        assert all(r[5] == (r[3] <= want * math.exp(0.1 / math.sqrt(r[2]))) for r in mine) and sum(r[3] == want and r[5] for r in mine) >= 1
        assert any(not r[5] for r in mine)


# ---- sharding


def test_shards_are_near_equal_and_slots_gapless(spark):
    rng = random.Random(16)
    rows = [(k, "é" * rng.randrange(200) if k % 50 else None, rng.choice(["en", "de", None]), "hot" if k % 3 else f"s{k % 7}", "clash") for k in range(3000)]
    rows += [(None, "same", "en", "hot", "x")] * 50
    got = kd_shards(spark.createDataFrame(rows, DOCS).repartition(5), shards=7).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    weights, slots = Counter(), defaultdict(list)
    for r in got:
        weights[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert sorted(weights) == list(range(7))
    assert max(weights.values()) - min(weights.values()) < 0.02 * sum(weights.values()) / 7
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_few_rows(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", "x"), (2, "b", "en", "s", "x")], DOCS)
    assert len(kd_shards(docs, shards=40).collect()) == 2
    assert kd_shards(docs.limit(0), shards=40).count() == 0
    assert {r.shard for r in kd_shards(docs, target_bytes=17).collect()} == {0, 1}

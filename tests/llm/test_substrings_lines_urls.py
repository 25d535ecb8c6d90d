from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from symloom.llm import substring_dedup as S
from symloom.llm.line_dedup import line_dedup
from symloom.llm.substring_dedup import substring_dedup
from symloom.llm.url_filter import UrlTrie, judge_urls, split_url

DOCS = "doc_id long, text string, kept string, source string"


def brute(rows, width, digests):
    """digests: of each text; of different texts that share a doc_id the one with the smaller digest is earlier."""
    first, out = {}, []
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (i, t), w in zip(rows, tokens, strict=True):
        for s in range(len(w) - width + 1) if i is not None else ():
            at = i, digests[t], s
            window = tuple(w[s : s + width])
            first[window] = min(first.get(window, at), at)
    for (i, t), w in zip(rows, tokens, strict=True):
        gone = set()
        for s in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[s : s + width])] != (i, digests[t], s):
                gone |= set(range(s, s + width))
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{k}é" if k % 5 == 0 else f"w{k}" for k in range(200)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([19, 20, 21, 60]))] for _ in range(6)]
    rows = []
    for k in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text[at:at] = rng.choice(passages)
        rows.append((k * 37 % 127, rng.choice([" ", "\n", "\t "]).join(text)))
    copy = rows[3][1] + " " + " ".join(passages[3])
    near = copy.split()
    near[25:25] = ["other"]
    shared = [(600, copy + " a"), (600, "b " + copy), (600, " ".join(near)), (601, copy + " a"), (602, "z z z " * 40)]
    return rows + shared + [(500, copy), (501, copy.replace(" ", "\n")), (None, copy), (502, None), (503, ""), (504, "z " * 300), rows[5], (505, "é " * 5000)]


@pytest.mark.parametrize(("tree_bytes", "held", "reach"), [(4_000_000, 50_000, 32), (2_000, 5, 7), (50, 100, 1)])
def test_substrings_against_brute_force(spark, monkeypatch, tree_bytes, held, reach):
    monkeypatch.setattr(S, "HELD", held)
    monkeypatch.setattr(S, "REACH", reach)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash", "s") for r in rows], DOCS).repartition(3)
    digests = {r.text: r.digest for r in docs.selectExpr("text", "xxhash64(text) AS digest").collect()}
    got = substring_dedup(docs, tree_bytes=tree_bytes).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 20, digests)


def test_prefixes_are_lengthened_until_they_fit(spark):
    rng = random.Random(3)
    bodies = [" ".join(rng.choice("abc") for _ in range(24)) for _ in range(400)] + ["x " * 23 + "x"] * 50
    suffixes = spark.createDataFrame([(k, 0, 0, b) for k, b in enumerate(bodies)], "doc_id long, digest long, at long, body string")
    got = S.prefixed(suffixes, 20, 1_000).collect()
    below = Counter()
    for r in got:
        below[r.key] += len(r.body) + 32
    assert {r.body for r in got if r.key is None} == {bodies[-1]}
    assert len(got) == 450 and max(n for key, n in below.items() if key is not None) <= 1_000
    # one prefix has one key, and the shortest that fits is taken
    for words in (1, 2, 4):
        size = Counter(" ".join(b.split()[:words]) for b in bodies for _ in range(len(b) + 32))
        assert all(len({r.key for r in got if r.body.startswith(p + " ")}) == 1 for p, n in size.items() if n <= 1_000)


def test_tree_has_the_nodes_of_its_suffixes():
    rng = random.Random(4)
    words = [tuple(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    tree = S.SuffixTree([("".join(w + " " for w in t).encode(), (k, 0, 0)) for k, t in enumerate(words)])
    assert tree.leaves == sorted(tree.leaves)
    got = {(depth, above, frozenset(leaf[0] for _, leaf in tree.leaves[a:b])) for depth, above, a, b in tree.nodes}
    want = set()
    for size in range(1, 9):
        for p in {t[:size] for t in words if len(t) >= size}:
            below = frozenset(k for k, t in enumerate(words) if t[:size] == p)
            goes_on = {words[k][size : size + 1] for k in below}
            if len(below) > 1 and (len(goes_on) > 1 or goes_on == {()}):
                above = max((d for d in range(size) if {k for k, t in enumerate(words) if t[:d] == p[:d]} != set(below)), default=0)
                # the parent is the deepest prefix with more suffixes below it
                want.add((size, above, below))
    assert got == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert substring_dedup(docs).count() == line_dedup(docs).count() == 0
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), []).count() == 0


def test_lines_against_brute_force(spark):
    rng = random.Random(12)
    lines = [f"line {k}" for k in range(30)] + ["", "  ", "\tfooter "]
    rows = [(k if k % 11 else None, "\n".join(rng.choice(lines[: 3 + k % 31]) for _ in range(rng.randrange(8))), f"s{k % 9}" if k % 13 else None) for k in range(150)] + [(900, None, "s1"), (901, "footer", "s2"), (900, None, "s1")]
    sites = {}
    for _, text, site in rows:
        for x in (text or "").split("\n") if text is not None else ():
            sites.setdefault(x.strip("\x20\t\x0b\x0c\r"), set()).add(site)
    for least in (3, 6, 9):
        wide = {x for x, s in sites.items() if len(s) >= least and x}
        want = []
        for i, text, _ in rows:
            own = text.split("\n") if text is not None else []
            kept = [x for x in own if x.strip("\x20\t\x0b\x0c\r") not in wide]
            want.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
        docs = spark.createDataFrame([(i, t, "clash", s) for i, t, s in rows], DOCS)
        assert sorted(map(tuple, line_dedup(docs, min_sites=least).collect()), key=str) == sorted(want, key=str)


def test_lines_of_thousands_of_sites_and_a_long_text(spark):
    # far from the threshold the sketch decides, near it the exact count
    spread = {"few": 1500, "below": 2999, "at": 3000, "above": 3001, "many": 6000}
    rows = spark.createDataFrame(list(spread.items()), "line string, n int").selectExpr("explode(sequence(1, n)) AS site", "line")
    docs = rows.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "line AS text", "'clash' AS kept", "CAST(site AS STRING) AS source")
    long = "\n".join(["many", "own"] * 20_000)
    docs = docs.union(spark.createDataFrame([(1, "\n".join([*spread, "x"]), "clash", "1"), (2, long, "clash", "2")], DOCS))
    got = {r.doc_id: r for r in line_dedup(docs, min_sites=3000).where("doc_id is not null").collect()}
    assert got[1].kept.split("\n") == ["few", "below", "x"]
    assert got[2].kept == "\n".join(["own"] * 20_000) and got[2].n_removed == 20_000


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es"), ("allow", "net", "/es/x/"), ("allow", "org", ""), ("block", "org", "")]
URLS = [None, "", "no scheme", "http://a.com", "http://A.COM/x", "http://example.com/en/1?q#f", "https://www.Example.com/en/", "x://m.www.example.com/en/y", "http://notexample.com/en/", "http://b.net/espace", "http://b.net/es/x/1", "http://b.net?/es/", "http://a.org#/en/", "http:///en/", "http://..com//"]


def brute_url(url):
    host, path = split_url(url)
    fits = [(len(h.split(".")), len(p), v == "block", v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[4], best[3] if best else "allow"


@pytest.mark.parametrize("trie_chars", [10_000, 0])
def test_urls_against_brute_force(spark, trie_chars):
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(URLS)] + [(None, "http://a.com/", "x")], "page_id long, url string, rule string")
    got = sorted(map(tuple, judge_urls(pages, RULES, trie_chars=trie_chars).collect()), key=str)
    assert got == sorted([(k, *brute_url(u)) for k, u in enumerate(URLS)] + [(None, *brute_url("http://a.com/"))], key=str)


def test_trie_prefers_the_longer_host():
    trie = UrlTrie([("block", "a.com", "/"), ("allow", "com", "/long/path/")])
    assert trie.match("a.com", "/long/path/x") == ("block", "a.com/")
    assert trie.match("b.com", "/long/path/x") == ("allow", "com/long/path/")
    assert Counter(map(trie.match, ["x.org", "com"], ["/", "/"])) == {None: 2}

from __future__ import annotations

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from symloom.operators import edges, flow, incremental, investigate, lookup, merge, resolve, traverse
from symloom.plans import catalog
from symloom.schema import SYMBOL_COLUMNS, struct

DATA = "/root/testdata/sf0.001"


def symbols(spark, *rows):
    """Rows of symbols from the columns that matter; paths, lines and types have defaults."""
    base = dict.fromkeys(SYMBOL_COLUMNS)
    made = []
    for r in rows:
        r = {"name": r["id"].split("::")[-1].split("#")[0], "qualified_name": r["id"].split("#")[0], "type": "function", "file_path": "src/a.cpp", "line": 1, "end_line": 9} | r
        made.append(tuple((base | r)[c] for c in SYMBOL_COLUMNS))
    return spark.createDataFrame(made, struct("symbols"))


def raw(spark, *rows):
    names = ["caller_id", "called_name", "call_kind", "argument_count", "receiver", "qualifier", "qualifier_kind", "pre_resolved_callee_id", "file_path", "line", "site_id"]
    made = [tuple(({"call_kind": "unqualified", "file_path": "src/z.cpp", "line": k, "site_id": k} | r).get(c) for c in names) for k, r in enumerate(rows)]
    return spark.createDataFrame(made, "caller_id string, called_name string, call_kind string, argument_count int, receiver string, qualifier string, qualifier_kind string, pre_resolved_callee_id string, file_path string, line int, site_id long")


def references(spark, *rows):
    return spark.createDataFrame([(s, t, c, "f", 1, "high") for s, t, c in rows], struct("symbol_references"))


def cells(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted((tuple(map(cell, r)) for r in rows), key=str)


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables here")
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, DATA)
    theirs = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert cells(ours.select(*columns).collect()) == cells(theirs.fetchall())


def test_entry_points(spark, duck):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
    assert catalog.QUERIES["g16_trace_variable_flow"](spark, DATA).count() > 0


def test_ties_and_scores_of_resolution(spark):
    known = symbols(spark, {"id": "b::f", "file_path": "q/w/b.py"}, {"id": "a::f", "file_path": "q/w/a.py"}, {"id": "one", "file_path": "x/y/z/u/v/w/o.py"}, {"id": "n::main", "file_path": "src/z.cpp"})
    sites = raw(spark, {"caller_id": "n::main", "called_name": "f", "argument_count": 1}, {"caller_id": "n::main", "called_name": "one"}, {"caller_id": "n::main", "called_name": "none"}, {"caller_id": "n::main", "called_name": "main"})
    got = {(r.callee_id, r.resolution_tier) for r in resolve.resolve_calls(sites, known, references(spark)).collect()}
    # two candidates tie below zero and are dropped; a single one stays whatever its score; a call of oneself is none
    assert got == {("one", "heuristic")}


def test_given_callees_and_qualifiers(spark):
    known = symbols(spark, {"id": "ns::f", "parameter_count": 0}, {"id": "ot::f", "parameter_count": 2}, {"id": "main"}, {"id": "C::g", "type": "method", "parent_id": "C"}, {"id": "C::h", "type": "method", "parent_id": "C"}, {"id": "D::h", "type": "method", "parent_id": "D"})
    sites = raw(
        spark,
        {"caller_id": "main", "called_name": "f", "pre_resolved_callee_id": "ot::f"},
        {"caller_id": "main", "called_name": "f", "pre_resolved_callee_id": "gone"},
        {"caller_id": "main", "called_name": "f", "call_kind": "qualified", "qualifier": "ot", "qualifier_kind": "namespace"},
        {"caller_id": "main", "called_name": "f", "argument_count": 0},
        {"caller_id": "C::g", "called_name": "h", "call_kind": "thisPointerAccess"},
    )
    got = {(r.line, r.callee_id, r.resolution_tier) for r in resolve.resolve_calls(sites, known, references(spark)).collect()}
    assert got == {(0, "ot::f", "compiler_confirmed"), (2, "ot::f", "heuristic"), (3, "ns::f", "heuristic"), (4, "C::h", "heuristic")}


def test_calls_that_are_alike_are_scored_once(spark):
    from pyspark.sql import functions as F

    known = symbols(spark, {"id": "a::f", "signature": "void f(bool on)", "file_path": "p/a.cpp"}, {"id": "b::f", "signature": "void f(const Widget& w)", "file_path": "p/b.cpp"}, {"id": "main", "file_path": "p/m.cpp"}, {"id": "other", "file_path": "p/m.cpp"})
    made = [{"caller_id": c, "called_name": "f", "argument_count": 1, "file_path": "p/m.cpp"} for c in ("main", "other", "main", "other")]
    texts = F.when(F.col("line") < 2, F.array(F.lit("true"))).otherwise(F.array(F.lit("my.widget")))
    sites = raw(spark, *made).withColumn("argument_texts", texts)
    got = {(r.caller_id, r.line, r.callee_id) for r in resolve.resolve_calls(sites, known, references(spark)).collect()}
    assert got == {("main", 0, "a::f"), ("other", 1, "a::f"), ("main", 2, "b::f"), ("other", 3, "b::f")}
    counts = {tuple(r) for r in resolve.candidate_counts(sites, known).collect()}
    assert counts == {("f", 8)}
    assert resolve.candidates(resolve.signed(sites, known), known, references(spark)).count() == 8


def test_member_access_against_brute_force(spark):
    receivers = ["m_Widget", "widget", "wid", "", None, "a.VeryLongOwnerName.b", "VERYLONGOWNERNAM", "veryLongOwnerNames", "x", "Été.widget"]
    names = ["Widget", "VeryLongOwnerName", "X", "", "été", None]
    calls = [{"caller_id": f"c{k}", "called_name": "f", "call_kind": kind, "receiver": r} for kind in ("memberAccess", "unqualified") for k, r in enumerate(receivers)]
    owners = spark.createDataFrame([(str(k), n) for k, n in enumerate(names)], "id string, name string")
    got = sorted((r.source_symbol_id, r.target_symbol_id) for r in edges.member_access(raw(spark, *calls), owners).collect())
    assert got == sorted((f"c{k}", n) for k, r in enumerate(receivers) if r is not None for n in names if n is not None and n.lower() in r.lower())


def test_argument_hints(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(["true", "theWidget"], "void f(bool on, const Widget& w)"), (["my.widget"], "void f(Widget *widget)"), ([], "void f(int)"), (["x"], None)], "a array<string>, s string")
    assert [r[0] for r in df.select(resolve.argument_hints(F.col("a"), F.col("s"))).collect()] == [70, 90, 0, 0]


def test_virtual_calls_reach_overrides(spark):
    known = symbols(spark, {"id": "A::u", "type": "method", "symbol_role": "virtual"}, {"id": "B::u", "type": "method"}, {"id": "C::u", "type": "method"}, {"id": "m"}, {"id": "A::v", "type": "method"})
    refs = references(spark, ("B::u", "A::u", "methodOverride"), ("C::u", "B::u", "methodOverride"), ("A::u", "C::u", "methodOverride"), ("C::u", "A::v", "methodOverride"))
    calls = spark.createDataFrame([("m", "A::u", "f", 1, "heuristic"), ("C::u", "A::u", "f", 2, "compiler_confirmed"), ("m", "A::v", "f", 3, "heuristic")], struct("calls"))
    got = {tuple(r) for r in resolve.expand_virtual(calls, known, resolve.override_closure(refs)).select("caller_id", "callee_id", "line", "resolution_tier").collect()}
    assert got == {("m", "A::u", 1, "heuristic"), ("m", "B::u", 1, "cha_virtual"), ("m", "C::u", 1, "cha_virtual"), ("C::u", "A::u", 2, "compiler_confirmed"), ("C::u", "B::u", 2, "cha_virtual"), ("m", "A::v", 3, "heuristic")}


@pytest.mark.parametrize("order", [1, -1])
def test_merging_does_not_depend_on_order(spark, order):
    rows = [
        {"id": "f", "file_path": "inc/f.hpp", "line": 3, "symbol_role": "declaration", "header_role": "public", "signature": "f()"},
        {"id": "f", "file_path": "src/f.cpp", "line": 30, "end_line": 40, "symbol_role": "definition", "module": "m"},
        {"id": "f", "file_path": "inc/f.inl.hpp", "line": 8, "symbol_role": "inline_definition", "subsystem": "s"},
        {"id": "g", "file_path": "inc/g.inl.hpp", "line": 1, "symbol_role": "inline_definition"},
        {"id": "g", "file_path": "inc/g.hpp", "line": 5, "symbol_role": "inline_definition"},
        {"id": "g", "file_path": "inc/h.hpp", "line": 5, "symbol_role": "declaration"},
    ]
    got = {r.id: r for r in merge.merge_symbols(symbols(spark, *rows[::order])).collect()}
    f, g = got["f"], got["g"]
    assert (f.file_path, f.signature, f.module, f.subsystem, f.header_role) == ("src/f.cpp", "f()", "m", "s", "public")
    assert (f.declaration_file_path, f.declaration_line, f.definition_file_path, f.definition_line, f.definition_end_line) == ("inc/f.hpp", 3, "src/f.cpp", 30, 40)
    assert (g.file_path, g.declaration_file_path, g.definition_file_path) == ("inc/g.hpp", "inc/h.hpp", "inc/g.hpp")
    ruled = merge.merge_symbols(symbols(spark, *rows[:2]), merge.Rules(demoted_prefixes=("src/",) * 9, preferred_prefixes=("inc/",), header_roles=("public",)))
    assert ruled.first().file_path == "src/f.cpp"


def test_callers_pages_and_filters(spark):
    known = symbols(spark, {"id": "t"}, {"id": "a::x", "subsystem": "s"}, {"id": "b::x", "subsystem": "s"}, {"id": "c::x"})
    calls = spark.createDataFrame([("b::x", "t", "f2", 9, "heuristic"), ("b::x", "t", "f1", 3, "compiler_confirmed"), ("a::x", "t", "f1", 5, "heuristic"), ("c::x", "t", "f1", 1, "heuristic"), ("gone", "t", "f", 1, "heuristic")], struct("calls"))
    seeds = spark.createDataFrame([("t",)], "id string")
    every = edges.unique_callers(calls, known, seeds).orderBy("position").collect()
    assert [(r.caller_id, r.file_path, r.line, r.total, r.truncated) for r in every] == [("a::x", "f1", 5, 3, False), ("b::x", "f1", 3, 3, False), ("c::x", "f1", 1, 3, False)]
    page = edges.unique_callers(calls, known, seeds, limit=1, offset=1).collect()
    assert [(r.caller_id, r.truncated) for r in page] == [("b::x", True)]
    assert [r.caller_id for r in edges.unique_callers(calls, known, seeds, subsystem="s", confirmed_only=True).collect()] == ["b::x"]


def test_recovered_callers(spark):
    known = symbols(
        spark,
        {"id": "World", "type": "class"}, {"id": "World::tick", "type": "method", "parent_id": "World", "parse_fragility": "elevated"},
        {"id": "Clock", "type": "class"}, {"id": "Clock::tick", "type": "method", "parent_id": "Clock", "file_path": "src/c.cpp"}, {"id": "main", "file_path": "src/m.cpp"}, {"id": "calm"},
    )
    sites = raw(spark, {"caller_id": "main", "called_name": "tick", "call_kind": "memberAccess", "receiver": "m_world"}, {"caller_id": "main", "called_name": "calm"}, {"caller_id": "calm", "called_name": "tick"})
    none = spark.createDataFrame([], struct("calls"))
    got = edges.recovered_callers(sites, known, references(spark), none).collect()
    # calm has no hint and is sound, so it is not recovered; a bare call ties and is dropped
    assert [(r.callee_id, r.caller_id, r.score) for r in got] == [("World::tick", "main", 650)]


def test_short_searches_find_nothing(spark):
    known = symbols(spark, {"id": "alpha"}, {"id": "n::alphabet"})
    assert lookup.search(known, "al").count() == 0
    assert [(r.id, r.total) for r in lookup.search(known, "ALPH", limit=1, offset=1).collect()] == [("n::alphabet", 2)]


@pytest.mark.parametrize("few", [0, 3, 100])
def test_paths_trees_and_caps(spark, monkeypatch, few):
    monkeypatch.setattr(traverse, "FEW", few)  # all edges numbered at once, from the second level on, or never
    calls = spark.createDataFrame([("a", "b", 2), ("a", "c", 1), ("b", "d", 1), ("c", "d", 1), ("d", "a", 1), ("d", "e", 2)], "src string, dst string, ord int")
    seeds = spark.createDataFrame([("a",)], "seed string")
    pairs = spark.createDataFrame([("a", "e"), ("a", "z"), ("a", "d")], "seed string, goal string")
    assert {(r.goal, r.length, r.path) for r in traverse.shortest_paths(calls, pairs, 5).collect()} == {("e", 3, "a>c>d>e"), ("d", 2, "a>c>d")}
    tree = traverse.call_tree(calls, seeds, 3, 200).orderBy("position").collect()
    assert [r.path for r in tree] == ["a>c", "a>c>d", "a>c>d>e", "a>b", "a>b>d", "a>b>d>e"]
    assert [r.path for r in traverse.call_tree(calls, seeds, 3, 4).orderBy("position").collect()] == ["a>c", "a>c>d", "a>c>d>e"]
    assert {(r.node, r.depth) for r in traverse.levels(calls, seeds, 9).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)}


def test_flow_is_the_longest_chain(spark):
    rows = [("o", f"o::local:{s}@1", None, s, "localVariable", f"o::local:{t}@1", None, t, "localVariable", "assignment", "f", n, "high", "") for s, t, n in [("a", "b", 1), ("b", "c", 2), ("x", "y", 3), ("c", "d", 4)]]
    events = spark.createDataFrame(rows, "owner_symbol_id string, source_anchor_id string, source_symbol_id string, source_expression_text string, source_anchor_kind string, target_anchor_id string, target_symbol_id string, target_expression_text string, target_anchor_kind string, propagation_kind string, file_path string, line int, confidence string, risk_text string")
    ids = spark.createDataFrame([("o",)], "id string")
    assert [r.line for r in flow.trace(events, ids, 3).orderBy("position").collect()] == [1, 2, 4]
    assert [r.line for r in flow.trace(events, ids, 9, max_edges=1).collect()] == [1]


def test_summaries_and_compact_rows(spark):
    from symloom.operators import shape

    fresh = spark.createDataFrame([("f", "new")], "callable_symbol_id string, file_path string")
    stored = spark.createDataFrame([("f", "old"), ("g", "old")], "callable_symbol_id string, file_path string")
    assert {tuple(r) for r in flow.union_summaries(fresh, stored).collect()} == {("f", "new"), ("g", "old")}
    events = spark.createDataFrame([("a", "x", None, "y")], "source_anchor_id string, source_expression_text string, target_anchor_id string, target_expression_text string")
    assert tuple(flow.without_texts(events).first()) == ("a", None, None, "y")
    assert shape.compact_rows(symbols(spark, {"id": "f"}), "symbol").columns == ["id", "qualified_name", "type", "file_path", "line"]


def test_an_incremental_build_equals_a_full_one(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "2"), ("old", "3")], "path string, content_hash string")
    disk = spark.createDataFrame([("a", "1"), ("b", "9"), ("new", "3"), ("bad", None)], "path string, content_hash string")
    plan = incremental.plan(disk, stored)
    assert {tuple(r) for r in plan.collect()} == {("a", "unchanged_content"), ("b", "content_changed"), ("old", "removed_path"), ("new", "new_path"), ("bad", "read_failed")}
    assert [tuple(r) for r in incremental.rename_hints(disk, stored).collect()] == [("old", "new")]
    before = spark.createDataFrame([("a", 1), ("b", 1), ("old", 1)], "file_path string, n int")
    full = spark.createDataFrame([("a", 1), ("b", 2), ("new", 3)], "file_path string, n int")
    touched = plan.where("status != 'unchanged_content'")
    after = incremental.replace_files(before, full.join(touched.selectExpr("path as file_path"), "file_path", "left_semi"), touched)
    assert {tuple(r) for r in after.collect()} == {tuple(r) for r in full.collect()}
    assert incremental.threshold(50, 5000) == 50 and incremental.threshold(50, 20000) == 100
    assert incremental.old_generations(["g1", "g2", "g3", "g4"], "g2", "g1", 1) == ["g3"]


def test_the_rest_stands_without_the_corpus_operators(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "symloom.llm", None)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    try:
        bare = importlib.reload(entry)
        assert set(bare.queries()) == set(catalog.QUERIES)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def _paths_by_walking(duck, depth):
    """Per callable the simple call paths down to depth in preorder, and the first shortest path to each node."""
    edges = duck.execute(catalog.duckdb_sql("SELECT caller_id, callee_id FROM calls GROUP BY 1, 2 ORDER BY 1, min(line), 2")).fetchall()
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)

    def tree(path):
        for b in out.get(path[-1], []):
            if b not in path and len(path) <= depth:
                yield [*path, b]
                yield from tree([*path, b])

    def shortest(seed):
        best, level = {seed: [seed]}, [[seed]]
        for _ in range(depth):
            level, before = [], level
            for path in before:
                for b in out.get(path[-1], []):
                    if b not in best:
                        best[b] = [*path, b]
                        level.append(best[b])
        return best

    return tree, shortest


def test_every_callable_is_a_seed(spark, duck):
    from itertools import islice

    kinds = dict(duck.execute(catalog.duckdb_sql("SELECT id, type FROM symbols WHERE type IN ('function', 'method')")).fetchall())
    tree, shortest = _paths_by_walking(duck, 3)
    want = {(s, k, len(p) - 1, p[-1], ">".join(p)) for s in kinds for k, p in enumerate(islice(tree([s]), 199), 1)}
    got = [tuple(r) for r in catalog.QUERIES["g10_callgraph_all"](spark, DATA).collect()]
    assert len(got) == len(want) > 0 and set(got) == want
    want = {(s, n, len(p) - 1, ">".join(p)) for s in kinds for n, p in shortest(s).items() if kinds.get(n) == "method"}
    got = [tuple(r) for r in catalog.QUERIES["g12_trace_call_path_all"](spark, DATA).collect()]
    assert len(got) == len(want) > 0 and set(got) == want
    linked = {(s, n) for s, n, length, _ in want if length}
    pairs = catalog.QUERIES["g17_investigate_workflow"](spark, DATA).select("source", "target", "path_found").collect()
    assert {(r.source, r.target) for r in pairs} == {(s, n) for s in kinds for n, kind in kinds.items() if kind == "method"}
    assert {(r.source, r.target) for r in pairs if r.path_found} == linked


def test_impact_of_every_callable_has_totals_and_flags(spark, duck):
    got = catalog.QUERIES["g13_impact_all"](spark, DATA).collect()
    assert {r.truncated for r in got} == {True, False} and max(r.total for r in got) > 10
    assert {r.seed for r in got} == {r[0] for r in duck.execute(catalog.duckdb_sql("SELECT id FROM symbols WHERE type IN ('function', 'method')")).fetchall()}


def test_impact_writes_nothing_down_that_is_only_reached(spark, monkeypatch):
    kept, cut = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: (kept.append(cut(df)), kept[-1])[1])
    monkeypatch.setattr(traverse, "WALKED", 13)
    names = {layer: [f"{layer}{k:02}" for k in range(n)] for layer, n in (("a", 60), ("b", 10), ("c", 60))}
    calls = spark.createDataFrame([(x, y, "f", 1, "heuristic") for p, q in ("ab", "bc") for x in names[p] for y in names[q]], struct("calls"))
    known = symbols(spark, *[{"id": i} for layer in names.values() for i in layer if i != "b00"])
    seeds = spark.createDataFrame([(i,) for i in names["a"]], "seed string")
    refs = references(spark, ("c59", "a00", "typeUsage"), ("c59", "a00", "moduleImport"), ("gone", "a00", "typeUsage"))
    got = traverse.impact(calls, refs, known, seeds, limit=100, top=2, flags=True).collect()
    assert {tuple(r[c] for c in ("seed", "symbol_id", "n", "total", "position", "truncated")) for r in got} == {(s, *r, k, False) for s in names["a"] for k, r in enumerate([("c59", 3, 69), ("b01", 1, 69)] if s == "a00" else [("b01", 1, 69), ("b02", 1, 69)], 1)}
    assert max(t.count() for t in kept) == 1200  # the edges; 60 seeds reach 70 symbols each
    few = traverse.impact(calls, refs, known, seeds, limit=5, flags=True).where("seed = 'a07'").collect()
    assert {(r.total, r.truncated) for r in few} == {(9, True)} and len(few) == 9


def test_include_walks_have_no_depth_limit(spark):
    chain = [(f"h{k:02}", f"h{k + 1:02}", 1, False) for k in range(66)]
    ring = [(f"r{k}", f"r{(k + 1) % 7}", 1, False) for k in range(7)] + [("r3", "r1", 2, False), ("r5", "sys", 3, True)]
    includes = spark.createDataFrame(chain + ring, "source_file string, included_file string, line int, is_system_include boolean")
    cycles = {tuple(r) for r in traverse.include_cycles(includes).collect()}
    assert cycles == {("r0>r1>r2>r3>r4>r5>r6", 7), ("r1>r2>r3", 3)}
    assert {tuple(r) for r in traverse.include_cycles(includes, max_length=4).collect()} == {("r1>r2>r3", 3)}
    reached = {(r.source, r.reached): r.depth for r in traverse.include_closure(includes.where("source_file like 'h0%' or source_file like 'h1%'")).collect()}
    assert reached == {(f"h{a:02}", f"h{b:02}"): b - a for a in range(20) for b in range(a + 1, 21)}
    fan_out = {r.path: r.depth for r in incremental.header_fanout(includes, spark.createDataFrame([("h66",)], "path string")).collect()}
    assert fan_out == {f"h{66 - k:02}": k for k in range(1, 67)}


def test_walks_write_down_no_paths(spark, monkeypatch):
    kept, cut = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: (kept.append(cut(df)), kept[-1])[1])
    monkeypatch.setattr(traverse, "BATCH", 50)
    names = {layer: [f"{layer}{k:02}" for k in range(30)] for layer in "abc"}
    graph = spark.createDataFrame([(x, y, 7 - (k % 5)) for p, q in ("ab", "bc") for x in names[p] for k, y in enumerate(names[q])] * 2 + [("c00", "a00", 1), (None, "a00", 1)], "src string, dst string, ord int")
    ids = lambda c, found: spark.createDataFrame([(i,) for i in found], f"{c} string")
    goals = ids("goal", [*names["c"], "a00", "alone"])
    for dense, block, seeds in ((8, 7, [*names["a"], "c00", "alone"]), (0, 1, ["a03", "c00", "alone"])):
        monkeypatch.setattr(traverse, "DENSE", dense)
        monkeypatch.setattr(traverse, "BLOCK", block)
        kept.clear()
        got = sorted(tuple(r) for r in traverse.paths_to_goals(graph, ids("seed", seeds), goals, 3).collect())
        pairs = ids("seed", seeds).crossJoin(goals)
        assert got == sorted((r.seed, r.goal, r.length, r.path) for r in traverse.shortest_paths(graph, pairs, 3).collect())
        assert max(t.count() for t in kept[:5]) <= 3601  # the edges, each twice


def test_coverage_of_all_pairs_equals_that_of_given_pairs(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(traverse, "BLOCK", 3)
    calls = spark.createDataFrame([(a, b, "f", n, "heuristic") for n, (a, b) in enumerate(["sa", "ab", "bm", "sk", "kn", "tn", "ux", "xy", "yo", "mp", "zo"])], struct("calls"))
    known = symbols(spark, *[{"id": i, "type": "method" if i in "mnopq" else "function"} | ({"parse_fragility": "elevated"} if i in "ko" else {}) for i in "sabktuxyzmnopq"])
    event = lambda owner, kind, risk: (owner, f"{owner}::local:v@1", owner, "v", "localVariable", f"{owner}::local:w@2", None, "w", "localVariable", kind, "f", 3, "partial" if risk else "high", [risk] if risk else [])
    sources, targets = known.select("id").where("type = 'function'"), known.select("id").where("type = 'method'")
    pairs = sources.select(sources["id"].alias("source")).crossJoin(targets.select(targets["id"].alias("target")))
    for events, cases in (([event("y", "fieldWrite", "pointerHeavyFlow"), event("q", "returnValue", ""), event("k", "fieldRead", "receiverAmbiguity"), event("a", "assignment", "")], [(3, 50)]),):
        flows = spark.createDataFrame(events, struct("propagation_events")).withColumn("risk_text", F.concat_ws(",", "risks"))
        for depth, most in cases:
            steps = investigate.handoff_steps(flows, calls, investigate.main_paths(calls, pairs, depth), pairs, most)
            want = cells(investigate.coverage(steps, known, pairs, most).collect())
            assert cells(investigate.coverage_between(flows, calls, known, sources, targets, depth, most).collect()) == want and len(want) == 45


def test_callables_that_score_alike_recover_no_caller_and_pairs_stay_where_they_are(spark):
    known = symbols(spark, {"id": "n::f#1"}, {"id": "n::f#2"}, {"id": "n::g", "parse_fragility": "elevated"}, {"id": "main", "file_path": "src/m.cpp"})
    sites = raw(spark, {"caller_id": "main", "called_name": "f", "receiver": "r"}, {"caller_id": "main", "called_name": "g"}, {"caller_id": "main", "called_name": "g"})
    got = edges.recovered_callers(sites, known, references(spark), spark.createDataFrame([], struct("calls")))
    assert [(r.callee_id, r.caller_id, r.line) for r in got.collect()] == [("n::g", "main", 1)]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()  # pairs were sorted and shuffled for one


def test_raw_calls_are_written_down_once_as_numbers(spark, duck, monkeypatch):
    from symloom.plans import views

    kept, cut = [], traverse.cut
    monkeypatch.setattr(resolve, "cut", lambda df: (kept.append(cut(df)), kept[-1])[1])
    monkeypatch.setattr(views, "SLICE", 2500)
    got = catalog.QUERIES["d5_resolve_calls"](spark, DATA)
    theirs = duck.execute(catalog.ORACLES["d5_resolve_calls"])
    assert cells(got.select(*[d[0] for d in theirs.description]).collect()) == cells(theirs.fetchall())
    parts = [dict(t.dtypes) for t in kept if {"pre_resolved_callee_id", "line"} <= set(t.columns)]
    assert len(parts) > 1 and all(t[c] == "int" for t in parts for c in ("caller_id", "called_name", "pre_resolved_callee_id", "file_path"))


def test_trees_of_whole_tables_write_down_no_paths(spark, monkeypatch):
    from symloom.operators import preorder

    kept = []
    for module in (traverse, preorder):
        monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: (kept.append(cut(df)), kept[-1])[1])
    assert catalog.QUERIES["g10_callgraph_all"](spark, DATA).columns == ["seed", "position", "depth", "node", "path"]
    assert kept and not any("path" in t.columns for t in kept)


def test_trees_of_whole_tables_are_those_of_a_plain_walk(spark, monkeypatch):
    import random
    from itertools import islice

    from symloom.operators import preorder

    for name, value in (("SPAN", 7), ("BLOCK", 8), ("TURN", 3), ("CHUNK", 50), ("NAMED", 10)):
        monkeypatch.setattr(preorder, name, value)
    draw = random.Random(8)
    most = {n: draw.choice([0, 1, 2, 3, 9]) for n in range(60)} | {0: 58, 1: 40, 59: 0}
    edges = [(a, draw.randrange(60), draw.choice([None, 1, 2, 3])) for a, n in most.items() for _ in range(n)]
    edges += [(a, 1, 0) for a in range(5, 40)] + [(2, 2, 0), (None, 3, 0), (3, None, 0), (0, 1, None), (1, 0, 9), (1, 0, 1)]
    lines: dict = {}
    for a, b, line in edges:
        if a is not None and b is not None:
            lines[a, b] = min((x for x in (lines.get((a, b)), line) if x is not None), default=None)
    kids: dict = {}
    for (a, b), line in sorted(lines.items(), key=lambda e: (e[1] is not None, e[1] or 0, e[0][1])):
        kids.setdefault(a, []).append(b)
    names = [f"n{k:02}" for k in range(62)]
    seeds = [*range(0, 50), 59, 60]

    def tree(path, depth):
        for b in kids.get(path[-1], []):
            if b not in path and len(path) <= depth:
                yield [*path, b]
                yield from tree([*path, b], depth)

    parts = [spark.createDataFrame(edges[k::2], "src int, dst int, ord int") for k in (0, 1)]
    ids, given = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "id string, k int"), spark.createDataFrame([(s,) for s in [*seeds, 4]], "seed int")
    for depth, cap in ((3, 200), (3, 12), (4, 30), (2, 2), (1, 6), (2, 1)):
        want = [(names[s], k, len(p) - 1, names[p[-1]], ">".join(names[x] for x in p)) for s in seeds for k, p in enumerate(islice(tree([s], depth), cap - 1), 1)]
        assert sorted(tuple(r) for r in preorder.call_trees(parts, given, ids, depth, cap).collect()) == sorted(want)
    none = spark.createDataFrame([], "seed int")
    assert preorder.call_trees(parts, none, ids).count() == preorder.call_trees([], given, ids).count() == 0


def test_callers_of_whole_tables_write_down_nothing_that_is_only_reached(spark, monkeypatch):
    from symloom.operators import preorder, walks
    from symloom.plans import views

    kept = []
    for module in (traverse, preorder, walks, views):
        monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: (kept.append(cut(df)), kept[-1])[1])
    assert catalog.QUERIES["g11_callers_recursive_all"](spark, DATA).columns == ["seed", "node", "depth"]
    assert kept and not any({"seed", "depth"} & set(t.columns) for t in kept)


def test_walks_of_whole_tables_are_those_of_a_plain_search(spark, monkeypatch):
    import random

    from symloom.operators import preorder, walks

    for module, name, value in ((preorder, "SPAN", 8), (walks, "BLOCK", 8), (walks, "BATCH", 20), (preorder, "CHUNK", 50), (preorder, "NAMED", 10)):
        monkeypatch.setattr(module, name, value)
    draw = random.Random(3)
    edges = [(draw.randrange(60), draw.randrange(60), draw.choice([None, 1, 2])) for _ in range(90)] + [(2, 2, 0), (None, 3, 0), (3, None, 0)] + [(0, b, 1) for b in range(50)]
    kids: dict = {}
    for a, b, _ in edges:
        kids.setdefault(a, set()).add(b)
    seeds = [*range(40), 60, 61]
    parts = [spark.createDataFrame(edges[k::2], "src int, dst int, ord int") for k in (0, 1)]
    ids, given = spark.createDataFrame([(f"n{k:02}", k) for k in range(62)], "id string, k int"), spark.createDataFrame([(s,) for s in seeds], "seed int")
    for depth in (1, 2, 4):
        want = []
        for s in seeds:
            found = {s: 0}
            for d in range(1, depth + 1):
                found |= {b: d for a in [a for a, x in found.items() if x == d - 1] for b in kids.get(a, ()) if b is not None and b not in found}
            want += [(f"n{s:02}", f"n{b:02}", d) for b, d in found.items()]
        assert sorted(tuple(r) for r in walks.levels(parts, given, ids, depth).collect()) == sorted(want)


def test_paths_of_whole_tables_are_those_of_given_pairs_and_names_stay_behind(spark, monkeypatch):
    import random

    from symloom.operators import preorder, walks
    from symloom.plans import views

    monkeypatch.setattr(preorder, "SPAN", 8)
    monkeypatch.setattr(walks, "BLOCK", 9)
    draw = random.Random(5)
    edges = [(draw.randrange(40), draw.randrange(40), draw.choice([1, 2, 3])) for _ in range(110)]
    name = lambda k: f"n{k:02}"
    ids, column = spark.createDataFrame([(name(k), k) for k in range(42)], "id string, k int"), lambda c, found: spark.createDataFrame([(x,) for x in found], c)
    seeds, goals = [*range(30), 41], [1, 7, 20, 33, 39, 41]
    got = walks.paths_to_goals([spark.createDataFrame(edges, "src int, dst int, ord int")], column("seed int", seeds), column("seed int", goals), ids, 3)
    text = spark.createDataFrame([(name(a), name(b), n) for a, b, n in edges], "src string, dst string, ord int")
    want = traverse.paths_to_goals(text, column("seed string", map(name, seeds)), column("goal string", map(name, goals)), 3)
    assert got.columns == want.columns and cells(got.collect()) == cells(want.collect())
    kept = []
    for module in (traverse, preorder, walks, views):
        monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: (kept.append(cut(df)), kept[-1])[1])
    assert catalog.QUERIES["g12_trace_call_path_all"](spark, DATA).columns == want.columns
    assert kept and not any({"kids", "src", "dst"} & set(t.columns) for t in kept)


def test_what_sources_reach_is_not_dealt_anew(spark, monkeypatch):
    from symloom.operators import preorder, walks
    from symloom.plans import views

    kept = []
    for module in (traverse, preorder, walks, views):
        monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: (kept.append(cut(df)), kept[-1])[1])
    plan = catalog.QUERIES["g17_investigate_workflow"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition " not in plan
    assert kept and not any({"kids", "src", "dst", "reached"} & set(t.columns) for t in kept)


def test_sites_that_score_alike_are_scored_once(spark, monkeypatch):
    kept, cut = [], edges.cut
    monkeypatch.setattr(edges, "cut", lambda df: (kept.append(cut(df)), kept[-1])[1])
    known = symbols(
        spark, {"id": "n::f", "parse_fragility": "elevated", "file_path": "src/f/x.cpp"},
        *[{"id": f"c{k}", "file_path": p} for k, p in enumerate(["a/1.cpp", "a/2.cpp", "b/x.hpp", "src/f/y.cpp", "src/f/x.cpp"])],
    )
    paths = ["a/1.cpp", "a/2.cpp", "b/x.hpp", "src/f/y.cpp", "src/f/x.cpp"]
    sites = raw(spark, *[{"caller_id": f"c{k}", "called_name": known.where("id = 'n::f'").first().name, "call_kind": "unqualified", "file_path": p} for k, p in enumerate(paths)])
    got = {r.caller_id: r.score for r in edges.recovered_callers(sites, known, references(spark), spark.createDataFrame([], struct("calls"))).collect()}
    assert {c: s - got["c0"] for c, s in got.items()} == {"c0": 0, "c1": 0, "c2": 45, "c3": 90, "c4": 240}
    assert [t.count() for t in kept if "near_site_path" in t.columns and "site" in t.columns] == [4]

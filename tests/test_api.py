from __future__ import annotations

from types import SimpleNamespace

import pytest

from symloom.api import BadRequest, Engine, NotFound
from symloom.operators import investigate
from tests.test_graph import raw, references, symbols

EVENTS = "owner_symbol_id string, source_anchor_id string, source_symbol_id string, source_expression_text string, source_anchor_kind string, target_anchor_id string, target_symbol_id string, target_expression_text string, target_anchor_kind string, propagation_kind string, file_path string, line int, confidence string, risk_text string"


@pytest.fixture(scope="module")
def graph(spark):
    known = symbols(
        spark,
        {"id": "game", "type": "namespace"}, {"id": "game::Actor", "type": "class", "parent_id": "game", "scope_qualified_name": "game"}, {"id": "game::Boss", "type": "class", "scope_qualified_name": "game", "parse_fragility": "elevated"},
        {"id": "game::Actor::update", "type": "method", "parent_id": "game::Actor", "parameter_count": 1}, {"id": "game::Boss::update", "type": "method", "parent_id": "game::Boss", "parameter_count": 1, "line": 5},
        {"id": "game::run", "scope_qualified_name": "game"}, {"id": "main", "file_path": "src/main.cpp"}, {"id": "game::helper"}, {"id": "game::Mode", "type": "enum"}, {"id": "game::Mode::A", "type": "enumMember", "parent_id": "game::Mode"},
    )
    calls = spark.createDataFrame([("main", "game::run", "src/main.cpp", 3, "compiler_confirmed"), ("game::run", "game::Actor::update", "src/a.cpp", 7, "heuristic"), ("game::run", "game::helper", "src/a.cpp", 8, "heuristic"), ("game::helper", "game::Boss::update", "src/a.cpp", 9, "heuristic")], "caller_id string, callee_id string, file_path string, line int, resolution_tier string")
    refs = references(spark, ("game::Boss", "game::Actor", "inheritanceMention"), ("game::run", "game::Actor", "typeUsage"), ("main", "game::Mode::A", "enumValueUsage"))
    rows = [
        ("game::run", "game::run::local:a@1", None, "a", "localVariable", None, "game::Actor::update", "dt", "parameter", "argumentToParameter", "src/a.cpp", 7, "partial", "pointerHeavyFlow"),
        ("game::Actor::update", "game::Actor::update::param:dt@1", None, "dt", "parameter", None, "game::Actor", "time", "field", "fieldWrite", "src/a.cpp", 20, "high", ""),
    ]
    files = spark.createDataFrame([("src/a.cpp", 8), ("src/main.cpp", 1), ("x.py", 2)], "path string, symbol_count int")
    return SimpleNamespace(symbols=known, symbols_raw=known, calls=calls, raw_calls=raw(spark), symbol_references=refs, propagation_events=spark.createDataFrame(rows, EVENTS), files=files)


def test_every_tool_answers(graph):
    e = Engine(graph)
    exact = e.lookup_symbol(qualified_name="game::run")
    assert [r.ref_id for r in exact["callers"].collect()] == ["main"] and exact["callees"].count() == 2
    assert e.lookup_function("run")["callees"].count() == 2
    assert [r.id for r in e.lookup_class("Actor")["members"].collect()] == ["game::Actor::update"]
    assert [r.caller_id for r in e.find_callers("run", confirmed_only=True)["callers"].collect()] == ["main"]
    assert {(r.qualified_name, r.n) for r in e.find_all_overloads("update").collect()} == {("game::Actor::update", 1), ("game::Boss::update", 1)}
    assert {r.source_symbol_id for r in e.find_references(qualified_name="game::Actor").collect()} == {"game::run", "game::Boss"}
    assert e.find_references(qualified_name="game::Mode").count() == 0
    assert e.find_references(qualified_name="game::Mode", include_enum_members=True).count() == 1
    assert {(r.side, r.kinds, r.risks) for r in e.explain_symbol_propagation("game::Actor::update").collect()} == {("incoming", "argumentToParameter=1", "pointerHeavyFlow"), ("outgoing", "fieldWrite=1", "")}
    assert e.trace_variable_flow("game::run").count() == 1
    assert {r.symbol_id for r in e.impact_analysis("game::run").collect()} == {"main", "game::Actor::update", "game::helper", "game::Boss::update"}
    assert e.list_file_symbols("src/main.cpp").count() == 1
    assert {r.id for r in e.list_namespace_symbols("game").collect()} == {"game::Actor", "game::Boss", "game::run"}
    assert e.list_class_members("game::Actor").count() == 1
    assert [(r.side, r.related_id) for r in e.get_type_hierarchy("game::Actor").collect()] == [("derived", "game::Boss")]
    assert [(r.base_id, r.confidence) for r in e.find_base_methods("game::Boss::update").collect()] == [("game::Actor::update", "high")]
    assert e.find_overrides("game::Actor::update").count() == 1
    assert e.trace_call_path("main", "game::Boss::update").first().path == "main>game::run>game::helper>game::Boss::update"
    assert e.trace_call_path("main", "game::Boss::update", confirmed_only=True).count() == 0
    assert {r.id for r in e.search_symbols("UPDATE").collect()} == {"game::Actor::update", "game::Boss::update"}
    assert {(r.language, r.n_files) for r in e.workspace_summary().collect()} == {("cpp", 2), ("python", 1)}
    assert e.get_callgraph("run", direction="both").count() == 4
    assert [r.path for r in e.find_callers_recursive("helper").orderBy("position").collect()] == ["game::helper>game::run", "game::helper>game::run>main"]
    assert {r.scope for r in e.anchor_context("game::Actor::update")["scopes"].collect()} == {"game", "game::Actor"}


def test_wrong_parameters(graph):
    e = Engine(graph)
    with pytest.raises(BadRequest):
        e.lookup_symbol()
    with pytest.raises(BadRequest):
        e.lookup_symbol("main", "game::run")
    with pytest.raises(NotFound):
        e.lookup_function("nothing")
    with pytest.raises(NotFound):
        e.list_namespace_symbols("game::Actor")


def test_investigations(spark, graph):
    pairs = spark.createDataFrame([("main", "game::Actor::update"), ("game::Boss", "main"), ("game::run", None)], "source string, target string")
    got = investigate.investigate(graph.calls, graph.propagation_events, graph.symbols, pairs)
    steps = sorted((r.hop, r.kind, r.from_id, r.to_id) for r in got["steps"].where("source = 'main'").collect())
    assert steps == [(1, "call", "main", "game::run"), (2, "call", "game::run", "game::Actor::update"), (3, "argumentToParameter", "a", "game::Actor::update"), (4, "fieldWrite", "dt", "game::Actor")]
    assert [r.kind for r in got["evidence"].where("source = 'main'").orderBy("position").collect()] == ["fieldAssignment", "boundaryArgument"]
    assert [r.kind for r in got["evidence"].where("source = 'game::run'").orderBy("position").collect()] == ["fieldAssignment", "boundaryArgument", "adjacentCall", "adjacentCall"]
    levels = {(r.source, r.path_found, r.coverage) for r in got["coverage"].collect()}
    assert levels == {("main", True, "partial"), ("game::Boss", False, "weak"), ("game::run", True, "partial")}
    assert [r.id for r in got["suggestions"].where("source = 'main'").orderBy("position").collect()] == ["game::Actor", "game::run"]

from __future__ import annotations

from symloom.functions import extract as X
from symloom.operators import merge, resolve
from symloom.sources import store, trees

CPP = """#include "ai.h"
#include <vector>
#include "x.h" // trailing
namespace game {
class Actor : public Base, private Other<int> {
 public:
  virtual void Update(int dt);
  void Tick() { Update(1); helper(2, max(3, 4)); }
};
enum class Mode { A, B };
void Actor::Update(int dt) {
  this->Tick();
  world->Find("a{b").Reset();
  math::clamp(dt, 0, 1); // call(x)
}
int helper(int a, int b) { if (a) { return b; } return a; }
}
"""
PY = '''import os.path
from pkg.mod import thing as t

class Child(Parent):
    """def fake(): pass"""
    def run(self, a, b=1):
        self.stop()
        t(a, f(b))

def top():
    return Child()
'''
TS = """import { a } from "./a";
export class View extends Base implements I {
  render(x: number): void { this.draw(x); helper(); }
}
function helper() { return 1; }
"""
RS = """mod inner { pub fn go(x: i32) -> i32 { step(x) } }
pub struct Point { x: i32 }
impl Shape for Point { fn area(&self) -> f64 { self.scale(2.0); geo::norm(1) } }
"""
LUA = """local m = require("core.util")
function Player:jump(h)
  if h then for i = 1, 2 do self:move(i) end end
end
local function free(a, b) return m.add(a, b) end
"""
MACROS = """#ifdef A
#define X 1
#if B
#endif
int f() {
#ifndef C
void g() {
#endif
#endif
#define F(x) x
#define Y
"""


def of(kind, rows):
    return [s for s in rows if s.kind == kind]


def test_cpp_scanner():
    rows = X.scan("a.cpp", CPP, "cpp")
    ids = {(s.more["id"], s.detail) for s in of("symbol", rows)}
    assert {("game", "namespace"), ("game::Actor", "class"), ("game::Actor::Update", "method"), ("game::Actor::Tick", "method"), ("game::Mode", "enum"), ("game::helper", "function")} <= ids
    calls = {(s.name, s.owner, s.detail, s.more["argument_count"]) for s in of("call", rows)}
    assert calls >= {("Update", "game::Actor::Tick", "unqualified", 1), ("helper", "game::Actor::Tick", "unqualified", 2), ("max", "game::Actor::Tick", "unqualified", 2), ("Tick", "game::Actor::Update", "thisPointerAccess", 0), ("Find", "game::Actor::Update", "pointerMemberAccess", 1), ("clamp", "game::Actor::Update", "qualified", 3)}
    assert not [c for c in calls if c[0] == "call"]
    assert {(s.name, s.owner) for s in of("reference", rows)} == {("Base", "game::Actor"), ("Other", "game::Actor")}
    roles = {(s.more["id"], s.more["role"], s.line) for s in of("symbol", rows) if s.name == "Update"}
    assert roles == {("game::Actor::Update", "virtual", 7), ("game::Actor::Update", "definition", 11)}


def test_other_scanners():
    py = X.scan("pkg/app/__init__.py", PY, "python")
    assert {s.more["id"] for s in of("symbol", py)} == {"python::pkg::app", "python::pkg::app::Child", "python::pkg::app::Child::run", "python::pkg::app::top"}
    assert {(s.name, s.detail) for s in of("reference", py)} == {("python::os::path", "moduleImport"), ("python::pkg::mod", "moduleImport"), ("Parent", "inheritanceMention")}
    assert {(s.name, s.more["argument_count"]) for s in of("call", py)} == {("stop", 0), ("t", 2), ("f", 1), ("Child", 0)}
    ts = X.scan("ui/index.ts", TS, "typescript")
    assert {s.more["id"] for s in of("symbol", ts)} == {"typescript::ui", "typescript::ui::View", "typescript::ui::View::render", "typescript::ui::helper"}
    assert {(s.name, s.owner) for s in of("call", ts)} == {("draw", "typescript::ui::View::render"), ("helper", "typescript::ui::View::render")}
    rs = X.scan("src/lib.rs", RS, "rust")
    assert {s.more["id"] for s in of("symbol", rs)} == {"rust::src", "rust::src::inner", "rust::src::inner::go", "rust::src::Point", "rust::src::Point::area"}
    assert {(s.name, s.detail) for s in of("call", rs)} == {("step", "unqualified"), ("scale", "thisPointerAccess"), ("norm", "qualified")}
    assert {(s.name, s.owner) for s in of("reference", rs)} == {("Shape", "rust::src::Point")}
    lua = X.scan("game/init.lua", LUA, "lua")
    assert {(s.more["id"], s.line, s.end_line) for s in of("symbol", lua)} >= {("lua::game::Player::jump", 2, 4), ("lua::game::free", 5, 5)}
    assert {s.name for s in of("reference", lua)} == {"lua::core::util"}
    assert ("move", "lua::game::Player::jump") in {(s.name, s.owner) for s in of("call", lua)}


def test_directives(spark):
    files = spark.createDataFrame([("a.cpp", CPP), ("m.h", MACROS), ("e.h", "")], "path string, text string")
    assert sorted(map(tuple, X.includes(files).collect())) == [("a.cpp", "ai.h", 1, False), ("a.cpp", "vector", 2, True)]
    assert sorted(map(tuple, X.blocks(files).collect())) == [("m.h", "A", 1, 9, False), ("m.h", "C", 6, 8, True)]
    assert sorted((r.name, r.value, r.macro_type) for r in X.macros(files).collect()) == [("F", "x", "functionLike"), ("X", "1", "conditionalDefine"), ("Y", None, "objectLike")]
    assert sorted(map(tuple, X.conditional_symbols(files).collect())) == [("m.h", "f", 5, "A", False), ("m.h", "g", 7, "A", False), ("m.h", "g", 7, "C", True)]
    risky = {r.path: tuple(r)[1:] for r in X.risks(files).collect()}
    assert risky == {"a.cpp": ("low", "low", "light"), "m.h": ("low", "low", "light"), "e.h": ("low", "low", "light")}


def test_enclosing_symbol_is_the_smallest(spark):
    sites = spark.createDataFrame([("a", 5), ("a", 50), ("b", 1)], "path string, line int")
    symbols = spark.createDataFrame([("outer", "a", 1, 20), ("z", "a", 4, 6), ("y", "a", 4, 6)], "id string, file_path string, line int, end_line int")
    assert {(r.path, r.line): r.symbol_id for r in X.enclosing(sites, symbols).collect()} == {("a", 5): "y", ("a", 50): None, ("b", 1): None}


def test_a_tree_becomes_a_graph(spark, tmp_path):
    root = tmp_path / "work"
    for name, text in {"src/a.cpp": CPP, "src/b.py": PY, ".git/x.py": "def f(): pass", "node_modules/y.ts": "x", "src/skip.me.cpp": "int z() {}", "src/readme.md": "# no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "src/bad.lua").write_bytes(b"function f()\n\xff\nend\n")
    found = trees.discover(spark, str(root), ignore=["# comment", "skip[.]me", "("])
    assert {r.path: r.language for r in found.collect()} == {"src/a.cpp": "cpp", "src/b.py": "python", "src/bad.lua": "lua"}
    rows = X.graph_rows(X.sightings(found))
    full = rows["symbols_raw"]
    for column in ("signature", "scope_qualified_name", "scope_kind", "declaration_file_path", "definition_file_path", "module", "subsystem", "project_area", "artifact_kind", "header_role", "parse_fragility", "macro_sensitivity", "include_heaviness"):
        full = full.selectExpr("*", f"cast(null as string) as {column}")
    for column in ("declaration_line", "declaration_end_line", "definition_line", "definition_end_line"):
        full = full.selectExpr("*", f"cast(null as int) as {column}")
    symbols = merge.merge_symbols(full)
    update = symbols.where("id = 'game::Actor::Update'").first()
    assert (update.line, update.symbol_role, update.definition_line) == (11, "definition", 11)
    references = spark.createDataFrame([], "source_symbol_id string, target_symbol_id string, category string, file_path string, line int, confidence string")
    calls = resolve.resolve_calls(rows["raw_calls"].selectExpr("*", "monotonically_increasing_id() as site_id").persist(), symbols, references)
    edges = {(r.caller_id, r.callee_id) for r in calls.collect()}
    assert {("game::Actor::Tick", "game::Actor::Update"), ("game::Actor::Tick", "game::helper"), ("game::Actor::Update", "game::Actor::Tick")} <= edges
    index = str(tmp_path / "index")
    first = store.publish(spark, index, "20240101", {"symbols": symbols, "calls": calls}, {"workspace_root": "w"})
    assert store.active(spark, index) == first and store.table(spark, index, "symbols").count() == symbols.count()
    assert store.table(spark, index, "files").count() == 0
    for k in range(2, 6):
        store.publish(spark, index, f"2024010{k}", {"calls": calls})
    assert store.generations(spark, index) == ["gen=20240104", "gen=20240105"] and store.stale(spark, index, {"workspace_root": "w"}) == "workspace_root"


def test_skips_and_compile_databases(spark, tmp_path):
    texts = [("big", "x" * (3 * 1024 * 1024)), ("odd", "\x00" * 200), ("blob", "\n".join(["1, 2, 3, 4, 5, 6, 7, 8"] * 20)), ("fine", "int a;\n" * 20 + "\x00" * 200), ("small", "hello")]
    from pyspark.sql import functions as F

    got = {r.path: r.why for r in spark.createDataFrame(texts, "path string, text string").select("path", trees.skip_reason(F.col("text")).alias("why")).collect()}
    assert got == {"big": "too_large", "odd": "binary", "blob": "numeric_blob", "fine": None, "small": None}
    (tmp_path / "c.json").write_text('[{"directory": "/w", "file": "a.cpp", "command": "cc -Iinc -I sys -DUNIT_TEST=1 -o out/a.o a.cpp"}, {"directory": "/w", "file": "b.cpp", "arguments": ["cc", "-DX", "b.cpp"], "output": "bin/tool/b.o"}]')
    rows = {r.file: r for r in trees.compile_database(spark, str(tmp_path / "c.json")).collect()}
    assert (rows["a.cpp"].include_dirs, rows["a.cpp"].defines, rows["a.cpp"].output) == (["inc", "sys"], ["UNIT_TEST"], "out/a.o")
    files = spark.createDataFrame([("a.cpp", "runtime"), ("b.cpp", "runtime"), ("c.cpp", "editor")], "path string, artifact_kind string")
    kinds = {r.path: r.artifact_kind for r in trees.overlay(files, trees.compile_database(spark, str(tmp_path / "c.json"))).collect()}
    assert kinds == {"a.cpp": "test", "b.cpp": "tool", "c.cpp": "editor"}
    assert trees.parse_extensions("py, .rs") == ("py", "rs") and trees.parse_extensions("py,exe") == trees.EXTENSIONS

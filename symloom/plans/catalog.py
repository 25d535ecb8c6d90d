"""The registered code-graph queries over the projected tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import extract
from symloom.functions import metadata as M
from symloom.functions import strings as S
from symloom.operators import edges as E
from symloom.operators import flow, incremental, investigate, lookup, merge, preorder, resolve, shape, traverse, walks
from symloom.plans.views import CODED, Graph, duckdb_sql
from symloom.sources import trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Pieces of SQL that several queries share.
_LANG = "CASE WHEN lower({p}) LIKE '%.lua' THEN 'lua' WHEN lower({p}) LIKE '%.py' THEN 'python' WHEN lower({p}) LIKE '%.ts' OR lower({p}) LIKE '%.tsx' THEN 'typescript' WHEN lower({p}) LIKE '%.rs' THEN 'rust' ELSE 'cpp' END"
_HEADER = "regexp_matches(lower({p}), '[.](h|hh|hpp|hxx|inl|inc)$')"
_IMPL = "regexp_matches(lower({p}), '[.](c|cc|cpp|cxx|m|mm)$')"
_TEST = "(coalesce(artifact_kind = 'test', false) OR regexp_matches(lower(file_path), '/(tests?|specs?|samples?|benchmarks?)/|_test[.]|[.]test[.]'))"
_GEN = "(coalesce(artifact_kind = 'generated', false) OR regexp_matches(lower(file_path), '/(generated|gen|autogen)/'))"
_DEPTH = "(len(string_split(qualified_name, '::')) - 1)"
_ARITY = "(CASE WHEN regexp_matches({s}, '[(].*[)]') THEN CASE WHEN trim(regexp_extract({s}, '[(](.*)[)]', 1)) IN ('', 'void') THEN 0 ELSE len(string_split(trim(regexp_extract({s}, '[(](.*)[)]', 1)), ',')) END END)"
_BASE = (
    "(CASE WHEN coalesce(symbol_role, '') = 'definition' AND NOT " + _HEADER.format(p="file_path") + " THEN 400 WHEN coalesce(symbol_role, '') IN ('definition', 'inline_definition') OR (definition_file_path IS NOT NULL AND "
    + _HEADER.format(p="file_path") + ") THEN 280 ELSE 160 END)"
)
_HEUR = (
    "(CASE artifact_kind WHEN 'runtime' THEN 20 WHEN 'editor' THEN 10 ELSE 0 END + CASE WHEN " + _TEST + " THEN 0 ELSE 8 END + CASE WHEN " + _GEN + " THEN 0 ELSE 8 END + CASE WHEN type = 'function' THEN 8 ELSE 0 END + CASE WHEN "
    + _IMPL.format(p="file_path") + " THEN 4 ELSE 0 END + CASE WHEN " + _DEPTH + " <= 1 THEN 6 WHEN " + _DEPTH + " = 2 THEN 2 ELSE 0 END)"
)


def query(sql: str | None = None):
    def register(function: Callable[[Graph], DataFrame]):
        name = function.__name__
        QUERIES[name] = lambda spark, folder: function(Graph(spark, folder))
        if sql is not None:
            ORACLES[name] = duckdb_sql(sql)
        return function

    return register


# ---- lookups


@query("SELECT id, name, type FROM symbols WHERE name IN (SELECT called_name FROM raw_calls)")
def q1_symbols_by_name(g):
    return lookup.by_name(g.symbols, g.raw_calls.select(F.col("called_name").alias("name"))).select("id", "name", "type")


@query("SELECT id, qualified_name FROM symbols WHERE id IN (SELECT callee_id FROM calls)")
def q3_symbols_by_ids(g):
    return lookup.by_id(g.symbols, g.calls.select(F.col("callee_id").alias("id"))).select("id", "qualified_name")


_REP = """row_number() OVER (PARTITION BY qualified_name ORDER BY CASE WHEN symbol_role = 'declaration' AND header_role = 'public' THEN 0 ELSE 1 END, CASE WHEN symbol_role = 'definition' THEN 0 ELSE 1 END,
  CASE WHEN header_role = 'public' THEN 0 ELSE 1 END, CASE WHEN regexp_matches(lower(file_path), '[.]inl[.](hpp|h|hxx)$') THEN 1 ELSE 0 END, CASE WHEN regexp_matches(lower(file_path), '/(tests?|samples?|generated)/') THEN 1 ELSE 0 END, file_path, line, id)"""


@query(f"SELECT id, qualified_name, file_path FROM (SELECT *, {_REP} AS n FROM symbols) WHERE n = 1")
def q4_representative_of_qualified_name(g):
    return lookup.by_qualified_name(g.symbols).select("id", "qualified_name", "file_path")


@query("SELECT id, file_path, symbol_role FROM symbols_raw UNION ALL SELECT id, file_path, symbol_role FROM symbols WHERE id NOT IN (SELECT id FROM symbols_raw)")
def q5_sightings(g):
    return lookup.sightings(g.symbols, g.symbols_raw).select("id", "file_path", "symbol_role")


@query("""
WITH c AS (SELECT callee_id AS id, count(DISTINCT caller_id) AS n FROM calls GROUP BY 1), d AS (SELECT caller_id AS id, count(DISTINCT callee_id) AS n FROM calls GROUP BY 1), m AS (SELECT parent_id AS id, count(*) AS n FROM symbols GROUP BY 1)
SELECT s.id, coalesce(c.n, 0) AS n_callers, coalesce(d.n, 0) AS n_callees, coalesce(m.n, 0) AS n_members FROM symbols s LEFT JOIN c USING (id) LEFT JOIN d USING (id) LEFT JOIN m USING (id)""")
def q6_exact_lookup(g):
    callers = g.calls.groupBy(F.col("callee_id").alias("id")).agg(F.count_distinct("caller_id").alias("n_callers"))
    callees = g.calls.groupBy(F.col("caller_id").alias("id")).agg(F.count_distinct("callee_id").alias("n_callees"))
    members = g.symbols.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n_members"))
    out = g.symbols.select("id").join(callers, "id", "left").join(callees, "id", "left").join(members, "id", "left")
    return out.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_callers", "n_callees", "n_members")])


@query(f"""
WITH s AS (SELECT id, {_BASE} + CASE WHEN artifact_kind = 'runtime' THEN 25 ELSE 0 END + CASE WHEN header_role = 'public' THEN 20 ELSE 0 END + CASE WHEN {_TEST} THEN 0 ELSE 10 END + CASE WHEN {_GEN} THEN 0 ELSE 10 END AS score FROM symbols_raw),
t AS (SELECT *, max(score) OVER (PARTITION BY id) AS top FROM s), u AS (SELECT id, count(*) AS n_sightings, max(score) AS top_score, count(*) FILTER (WHERE score = top) AS n_top FROM t GROUP BY id)
SELECT *, CASE WHEN top_score >= 400 AND n_top = 1 THEN 'canonical' WHEN top_score >= 280 THEN 'acceptable' ELSE 'weak' END AS confidence FROM u""")
def q7_representative_explanation(g):
    return lookup.representative_report(g.symbols, g.symbols_raw)


@query("""
WITH f AS (SELECT id, qualified_name FROM symbols WHERE (contains(lower(name), 'ring') OR contains(lower(qualified_name), 'ring')) AND type = 'function' AND artifact_kind = 'runtime'),
p AS (SELECT id, row_number() OVER (ORDER BY qualified_name, id) AS position FROM f)
SELECT id, position, (SELECT count(*) FROM f) AS total FROM p WHERE position > 10 AND position <= 60""")
def q8_search(g):
    return lookup.search(g.symbols, "RING", types=["function"], limit=50, offset=10, artifact_kind="runtime")


@query("SELECT id FROM symbols WHERE contains(lower(name), 'widget') OR contains(lower(qualified_name), 'widget')")
def s11_trigram_search(g):
    return lookup.search_indexed(g.symbols, lookup.trigrams(g.symbols), "Widget")


@query("SELECT parent_id, id, type FROM symbols WHERE parent_id IN (SELECT id FROM symbols WHERE type IN ('class', 'namespace'))")
def q9_members(g):
    owners = g.symbols.where("type in ('class', 'namespace')").select(F.col("id").alias("parent_id"))
    return g.symbols.join(owners, "parent_id", "left_semi").select("parent_id", "id", "type")


_NEAR = "(CASE WHEN split_part(lower(file_path), '/', 1) = 'src' THEN 30 ELSE 0 END + CASE WHEN split_part(lower(file_path), '/', 1) = 'src' AND split_part(lower(file_path), '/', 2) = 'economy' THEN 30 ELSE 0 END + CASE WHEN list_contains(string_split(lower(file_path), '/')[1:-2], 'src') THEN 10 ELSE 0 END + CASE WHEN list_contains(string_split(lower(file_path), '/')[1:-2], 'economy') THEN 10 ELSE 0 END)"


@query(f"""
WITH r AS (SELECT id, name, {_HEUR} + CASE WHEN {_LANG.format(p='file_path')} = 'cpp' THEN 80 ELSE 0 END + CASE WHEN subsystem = 'economy' THEN 120 ELSE 0 END + {_NEAR} AS score, {_BASE} AS base, file_path, line, qualified_name FROM symbols WHERE type IN ('function', 'method'))
SELECT id, name, score, row_number() OVER (PARTITION BY name ORDER BY score DESC, base DESC, file_path, line, qualified_name, id) AS rank FROM r""")
def q10_function_lookup(g):
    return lookup.ranked(g.symbols, lookup.CALLABLE, language="cpp", subsystem="economy", file_path="src/economy/x.cpp").select("id", "name", "score", "rank")


@query(f"""
WITH r AS (SELECT id, name, {_HEUR} + CASE WHEN qualified_name = 'ASIA' OR starts_with(qualified_name, 'ASIA::') THEN 70 ELSE 0 END AS score, {_BASE} AS base, file_path, line, qualified_name FROM symbols WHERE type IN ('class', 'struct'))
SELECT id, name, score, row_number() OVER (PARTITION BY name ORDER BY score DESC, base DESC, file_path, line, qualified_name, id) AS rank FROM r""")
def q11_class_lookup(g):
    return lookup.ranked(g.symbols, ["class", "struct"], scopes=("ASIA",)).select("id", "name", "score", "rank")


@query("SELECT name, type, qualified_name, count(*) AS n, string_agg(id, ',' ORDER BY file_path, line, id) AS ids FROM symbols WHERE type IN ('function', 'method') GROUP BY ALL")
def q12_overloads(g):
    return lookup.overloads(g.symbols)


def _overview_sql(owner: str, limit: int, where: str = "true") -> str:
    return f"""
WITH i AS (SELECT {owner} AS owner, id, type, line, end_line, qualified_name FROM symbols WHERE {owner} IS NOT NULL AND {where}),
c AS (SELECT owner, cast(sum(n) AS bigint) AS total, string_agg(type || '=' || n, ',' ORDER BY type) AS type_counts FROM (SELECT owner, type, count(*) AS n FROM i GROUP BY ALL) GROUP BY owner),
p AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY line, end_line, qualified_name, id) AS position FROM i)
SELECT owner, position, id, type, total, type_counts, total > {limit} AS truncated FROM p JOIN c USING (owner) WHERE position <= {limit}"""


@query(_overview_sql("file_path", 20))
def q13_file_symbols(g):
    return lookup.overview(g.symbols, "file_path", 20)


@query(_overview_sql("scope_qualified_name", 30, "scope_kind = 'namespace'"))
def q14_namespace_symbols(g):
    return lookup.overview(g.symbols.where("scope_kind = 'namespace'"), "scope_qualified_name", 30)


@query(_overview_sql("parent_id", 10))
def q15_class_members(g):
    return lookup.overview(g.symbols, "parent_id", 10)


@query(f"""
WITH e AS (SELECT DISTINCT source_symbol_id AS d, target_symbol_id AS b FROM symbol_references WHERE category = 'inheritanceMention')
SELECT b.id AS base_id, d.id AS derived_id, CASE WHEN coalesce(d.parameter_count = b.parameter_count OR {_ARITY.format(s='d.signature')} = {_ARITY.format(s='b.signature')}, false) THEN 'high' ELSE 'partial' END AS confidence
FROM symbols d JOIN e ON d.parent_id = e.d JOIN symbols b ON b.parent_id = e.b AND b.name = d.name WHERE d.type = 'method' AND b.type = 'method'""")
def q16_q17_base_and_override_methods(g):
    return lookup.override_candidates(g.symbols, g.symbol_references)


@query("SELECT DISTINCT r.source_symbol_id AS derived_id, s.id AS base_id, s.name FROM symbol_references r JOIN symbols s ON s.id = r.target_symbol_id WHERE category = 'inheritanceMention'")
def q18_direct_bases(g):
    refs = g.symbol_references.where("category = 'inheritanceMention'")
    return refs.join(g.symbols, F.col("target_symbol_id") == F.col("id")).select(F.col("source_symbol_id").alias("derived_id"), F.col("id").alias("base_id"), "name").distinct()


@query("""
WITH e AS (SELECT DISTINCT source_symbol_id AS d, target_symbol_id AS b FROM symbol_references WHERE category = 'inheritanceMention'),
u AS (SELECT d AS id, 0 AS side, b AS related_id FROM e UNION ALL SELECT b, 1, d FROM e),
p AS (SELECT u.id, side, related_id, row_number() OVER (PARTITION BY u.id ORDER BY side, qualified_name, related_id) AS position FROM u JOIN symbols s ON s.id = related_id)
SELECT id, CASE side WHEN 0 THEN 'base' ELSE 'derived' END AS side, related_id, position FROM p WHERE position <= 3""")
def q19_type_hierarchy(g):
    return lookup.type_hierarchy(g.symbols, g.symbol_references, 3)


@query(f"SELECT {_LANG.format(p='path')} AS language, count(*) AS n_files, cast(sum(symbol_count) AS bigint) AS n_symbols FROM files GROUP BY 1")
def q20_workspace_summary(g):
    return lookup.workspace_summary(g.files)


@query("""
SELECT (SELECT count(*) FROM symbols) AS n_symbols, (SELECT count(*) FROM calls) AS n_calls, (SELECT count(*) FROM symbol_references) AS n_references, (SELECT count(*) FROM propagation_events) AS n_propagation, count(*) AS n_files,
  count(*) FILTER (WHERE parse_fragility = 'elevated') AS n_fragile, count(*) FILTER (WHERE macro_sensitivity = 'high') AS n_macro, count(*) FILTER (WHERE include_heaviness = 'heavy') AS n_heavy FROM files""")
def q21_index_details(g):
    return lookup.index_details(g)


@query("SELECT subsystem AS key, count(DISTINCT id) AS n FROM symbols WHERE subsystem <> '' GROUP BY 1")
def q22_metadata_groups(g):
    return lookup.metadata_groups(g.symbols, F.col("subsystem"))


# ---- edges


@query("SELECT caller_id, callee_id, count(*) AS n FROM calls WHERE resolution_tier = 'compiler_confirmed' GROUP BY ALL")
def g1_confirmed_edges(g):
    return E.edges_of(g.calls, confirmed_only=True).groupBy("caller_id", "callee_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c.callee_id, s.qualified_name, c.file_path, c.line FROM calls c JOIN symbols s ON s.id = c.caller_id")
def g2_call_refs(g):
    return E.call_refs(g.calls, g.symbols).select("callee_id", "qualified_name", "file_path", "line")


_CALLERS = """
WITH f AS (SELECT callee_id, s.id AS caller_id, s.qualified_name, c.file_path, c.line, row_number() OVER (PARTITION BY callee_id, s.id ORDER BY c.file_path, c.line) AS first FROM calls c JOIN symbols s ON s.id = c.caller_id {where}),
p AS (SELECT *, row_number() OVER (PARTITION BY callee_id ORDER BY qualified_name, file_path, line, caller_id) AS position, count(*) OVER (PARTITION BY callee_id) AS total FROM f WHERE first = 1)
SELECT callee_id, caller_id, file_path, line, position, total, total > {end} AS truncated FROM p WHERE position > {offset} AND position <= {end}"""


@query(_CALLERS.format(where="", offset=0, end=50))
def g3_find_callers(g):
    return E.unique_callers(g.calls, g.symbols, g.symbols, limit=50)


@query(_CALLERS.format(where="WHERE c.resolution_tier = 'compiler_confirmed' AND s.subsystem = 'economy' AND s.artifact_kind = 'runtime'", offset=2, end=7))
def g3_find_callers_filtered(g):
    return E.unique_callers(g.calls, g.symbols, g.symbols, limit=5, offset=2, confirmed_only=True, subsystem="economy", artifact_kind="runtime")


@query(f"""
WITH r AS (SELECT DISTINCT callee_id, s.id, s.subsystem, s.module, {_LANG.format(p='s.file_path')} AS language FROM calls c JOIN symbols s ON s.id = c.caller_id),
u AS (SELECT callee_id, id, 'subsystem' AS grouping_name, subsystem AS key FROM r UNION ALL SELECT callee_id, id, 'module', module FROM r UNION ALL SELECT callee_id, id, 'language', language FROM r)
SELECT callee_id, grouping_name, key, count(DISTINCT id) AS n FROM u WHERE key <> '' GROUP BY ALL""")
def g4_caller_groups(g):
    return E.caller_groups(g.calls, g.symbols)


@query("""
WITH n AS (SELECT callee_id AS id, count(DISTINCT caller_id) AS n FROM calls GROUP BY 1),
f AS (SELECT s.id, concat_ws(',', CASE WHEN parse_fragility = 'elevated' THEN 'elevated_parse_fragility' END, CASE WHEN macro_sensitivity = 'high' THEN 'macro_sensitive' END, CASE WHEN include_heaviness = 'heavy' THEN 'include_heavy' END) AS factors, coalesce(n, 0) AS n_related FROM symbols s LEFT JOIN n USING (id))
SELECT id, factors, CASE WHEN factors = '' THEN 'full' WHEN n_related = 0 THEN 'low' ELSE 'partial' END AS coverage, CASE WHEN factors = '' THEN 'full' WHEN n_related = 0 THEN 'low' ELSE 'partial' END AS level, n_related FROM f""")
def r6_reliability(g):
    return E.reliability(g.symbols, g.calls.groupBy(F.col("callee_id").alias("id")).agg(F.count_distinct("caller_id").alias("n_related")))


_WITHIN = "coalesce({s} <> '' AND {q} <> '' AND ({q} = {s} OR ends_with({s}, '::' || {q}) OR ends_with({q}, '::' || {s})), false)"
_PLAIN = "lower(regexp_replace(regexp_replace({c}, '^[mpMP]_?', ''), '[^a-zA-Z0-9]+', '', 'g'))"
_STEM = "regexp_replace(regexp_extract({c}, '[^/]*$'), '[.][^.]+$', '')"
_DIR = "CASE WHEN contains({c}, '/') THEN regexp_replace({c}, '/[^/]*$', '') END"


def _plus(condition: str, points: int) -> str:
    return f"CASE WHEN coalesce({condition}, false) THEN {points} ELSE 0 END"


_G5 = f"""
WITH op AS (SELECT * FROM symbols WHERE type IN ('function', 'method') AND id NOT IN (SELECT callee_id FROM kept_calls)),
kept_calls AS (SELECT callee_id FROM calls WHERE resolution_tier = 'cha_virtual' AND line = 1),
hint AS (SELECT called_name AS name, max(CASE WHEN receiver IS NOT NULL OR qualifier IS NOT NULL THEN 1 ELSE 0 END) AS hinted FROM raw_calls GROUP BY 1),
site AS (SELECT DISTINCT called_name, caller_id, file_path AS site_path, line AS site_line, call_kind, receiver, qualifier FROM raw_calls WHERE called_name IN (SELECT name FROM op)),
p AS (
  SELECT t.*, s.id, s.type, s.name, s.parse_fragility,
    100 + CASE WHEN s.type = 'method' THEN
      {_plus("call_kind IN ('memberAccess', 'pointerMemberAccess', 'thisPointerAccess')", 180)} + {_plus("c.parent_id = s.parent_id", 260)} + {_plus("receiver = 'this' AND c.parent_id = s.parent_id", 260)}
      + {_plus(f"{_PLAIN.format(c='receiver')} <> '' AND {_PLAIN.format(c='o.name')} <> '' AND (ends_with({_PLAIN.format(c='receiver')}, {_PLAIN.format(c='o.name')}) OR ends_with({_PLAIN.format(c='o.name')}, {_PLAIN.format(c='receiver')}))", 280)}
      + {_plus("b.d IS NOT NULL", 220)}
      + CASE WHEN {_WITHIN.format(q='qualifier', s='o.qualified_name')} OR {_WITHIN.format(q='qualifier', s='o.name')} THEN 240 WHEN qualifier IS NOT NULL THEN -120 ELSE 0 END
    ELSE {_plus("call_kind = 'unqualified'", 140)} + CASE WHEN {_WITHIN.format(q='qualifier', s="CASE WHEN s.scope_kind = 'namespace' THEN s.scope_qualified_name ELSE regexp_replace(s.qualified_name, '::[^:]*$', '') END")} THEN 240 WHEN qualifier IS NOT NULL THEN -120 ELSE 0 END END
    + {_plus("s.scope_qualified_name = c.scope_qualified_name", 80)} + {_plus("s.subsystem = c.subsystem", 25)} + {_plus("s.module = c.module", 25)} + {_plus("s.project_area = c.project_area", 20)}
    + CASE WHEN site_path = s.file_path OR coalesce(site_path = s.definition_file_path, false) OR coalesce(site_path = s.declaration_file_path, false) THEN 240
      ELSE {_plus(f"{_DIR.format(c='site_path')} = {_DIR.format(c='s.file_path')}", 90)} + {_plus(f"{_STEM.format(c='site_path')} = {_STEM.format(c='s.file_path')}", 45)} END AS score
  FROM site t JOIN symbols s ON s.name = t.called_name AND s.type IN ('function', 'method') JOIN symbols c ON c.id = t.caller_id LEFT JOIN symbols o ON o.id = s.parent_id
  LEFT JOIN (SELECT DISTINCT source_symbol_id AS d, target_symbol_id AS t FROM symbol_references WHERE category = 'inheritanceMention') b ON b.d = c.parent_id AND b.t = s.parent_id),
w AS (SELECT *, max(score) OVER k AS best FROM p WINDOW k AS (PARTITION BY called_name, caller_id, site_path, site_line, call_kind, receiver, qualifier)),
v AS (SELECT *, count(*) OVER (PARTITION BY called_name, caller_id, site_path, site_line, call_kind, receiver, qualifier) AS ties FROM w WHERE score = best),
m AS (SELECT v.* FROM v JOIN hint USING (name) WHERE ties = 1 AND score > 0 AND (parse_fragility = 'elevated' OR hinted = 1) AND id IN (SELECT id FROM op) AND id <> caller_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id, caller_id ORDER BY score DESC, site_path, site_line) AS n FROM m)
SELECT id AS callee_id, caller_id, site_path AS file_path, site_line AS line, score FROM r WHERE n = 1"""


@query(_G5.replace("WITH op AS", "WITH kept_calls AS (SELECT callee_id FROM calls WHERE resolution_tier = 'cha_virtual' AND line = 1),\nop AS").replace("kept_calls AS (SELECT callee_id FROM calls WHERE resolution_tier = 'cha_virtual' AND line = 1),\nhint", "hint"))
def g5_recovered_callers(g):
    return E.recovered_callers(g.raw_calls, g.symbols, g.symbol_references, g.calls.where("resolution_tier = 'cha_virtual' and line = 1"))


@query("SELECT called_name, call_kind, count(*) AS n, min(line) AS first_line FROM raw_calls GROUP BY ALL")
def g6_raw_calls_by_name(g):
    return g.raw_calls.groupBy("called_name", "call_kind").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))


@query("""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY target_symbol_id ORDER BY category, file_path, line, source_symbol_id, confidence) AS position FROM symbol_references WHERE category = 'typeUsage')
SELECT target_symbol_id, position, source_symbol_id, file_path, line FROM p WHERE position <= 100""")
def g7_references(g):
    return E.references(g.symbol_references, category="typeUsage", cap=100).select("target_symbol_id", "position", "source_symbol_id", "file_path", "line")


_ACCESS = "SELECT caller_id AS source_symbol_id, n.name AS target_symbol_id, 'memberAccess' AS category, file_path, line FROM raw_calls JOIN (SELECT DISTINCT name FROM symbols WHERE type = 'class') n ON contains(lower(receiver), lower(n.name)) WHERE call_kind IN ('memberAccess', 'pointerMemberAccess', 'fieldAccess', 'pointerFieldAccess', 'thisFieldAccess')"


@query(f"SELECT source_symbol_id, target_symbol_id, file_path, line FROM ({_ACCESS})")
def g8_member_access(g):
    return E.member_access(g.raw_calls, g.symbols.where("type = 'class'")).select("source_symbol_id", "target_symbol_id", "file_path", "line")


@query(f"""
WITH u AS (SELECT source_symbol_id, target_symbol_id, category, file_path, line FROM symbol_references UNION SELECT * FROM ({_ACCESS})),
p AS (SELECT *, row_number() OVER w AS position, count(*) OVER (PARTITION BY target_symbol_id) AS total FROM u WHERE source_symbol_id IN (SELECT id FROM symbols) WINDOW w AS (PARTITION BY target_symbol_id ORDER BY category, file_path, line, source_symbol_id))
SELECT target_symbol_id, position, total, source_symbol_id, category FROM p WHERE position <= 25""")
def g9_find_references(g):
    access = E.member_access(g.raw_calls, g.symbols.where("type = 'class'"))
    return E.reference_query(g.symbol_references, access, g.symbols, 25).select("target_symbol_id", "position", "total", "source_symbol_id", "category")


@query("SELECT target_symbol_id, file_path, string_agg(line || ':' || source_symbol_id, ',' ORDER BY line, source_symbol_id) AS entries FROM symbol_references GROUP BY ALL")
def r4_references_by_file(g):
    return E.grouped_by_file(g.symbol_references)


# ---- traversals


def _edges(g) -> DataFrame:
    return g.calls.select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), F.col("line").alias("ord"))


def _seed_names(g) -> DataFrame:
    """The asked-for symbols: all callables of one name."""
    return lookup.ranked(g.symbols, lookup.CALLABLE).where("name = 'red_widget_1'").select(F.col("id").alias("seed"))


_SEEDS = "(SELECT id AS seed FROM symbols WHERE type IN ('function', 'method') AND name = 'red_widget_1')"
_RANKED = "e AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY ord, dst) AS n FROM (SELECT caller_id AS src, callee_id AS dst, min(line) AS ord FROM calls GROUP BY 1, 2))"


@query(f"""
WITH RECURSIVE {_RANKED},
t AS (SELECT seed, seed AS node, [] :: INTEGER[] AS ranks, [seed] AS path FROM {_SEEDS} UNION ALL
  SELECT seed, dst, list_append(ranks, cast(n AS INTEGER)), list_append(path, dst) FROM t JOIN e ON src = node WHERE len(ranks) < 3 AND NOT list_contains(path, dst)),
p AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY ranks) AS position FROM t WHERE len(ranks) > 0)
SELECT seed, position, len(ranks) AS depth, node, array_to_string(path, '>') AS path FROM p WHERE position < 200""")
def g10_callgraph(g):
    return traverse.call_tree(_edges(g), _seed_names(g), max_depth=3, node_cap=200)


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT callee_id AS src, caller_id AS dst FROM calls),
t AS (SELECT seed, seed AS node, 0 AS depth FROM {_SEEDS} UNION SELECT seed, dst, depth + 1 FROM t JOIN e ON src = node WHERE depth < 2)
SELECT seed, node, min(depth) AS depth FROM t GROUP BY ALL""")
def g11_callers_recursive(g):
    up = g.calls.select(F.col("callee_id").alias("src"), F.col("caller_id").alias("dst"), F.col("line").alias("ord"))
    return traverse.levels(up, _seed_names(g), 2)


@query(f"""
WITH RECURSIVE {_RANKED},
t AS (SELECT seed, seed AS node, [] :: INTEGER[] AS ranks, [seed] AS path FROM {_SEEDS} UNION ALL
  SELECT seed, node, ranks, path FROM (SELECT seed, dst AS node, list_append(ranks, cast(n AS INTEGER)) AS ranks, list_append(path, dst) AS path, row_number() OVER (PARTITION BY seed, dst ORDER BY list_append(ranks, cast(n AS INTEGER))) AS k FROM t JOIN e ON src = node WHERE len(ranks) < 3) WHERE k = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY seed, node ORDER BY len(ranks), ranks) AS k FROM t)
SELECT seed, node AS goal, len(ranks) AS length, array_to_string(path, '>') AS path FROM b WHERE k = 1 AND node IN (SELECT id FROM symbols WHERE type = 'method')""")
def g12_trace_call_path(g):
    goals = g.symbols.where("type = 'method'").select(F.col("id").alias("goal"))
    return traverse.paths_to_goals(_edges(g), _seed_names(g), goals, 3)


@query(f"""
WITH d AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY ord, dst) AS n FROM (SELECT caller_id AS src, callee_id AS dst, min(line) AS ord FROM calls GROUP BY 1, 2)) WHERE n <= 5),
u AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY ord, dst) AS n FROM (SELECT callee_id AS src, caller_id AS dst, min(line) AS ord FROM calls GROUP BY 1, 2)) WHERE n <= 5),
v AS (
  SELECT DISTINCT seed, node, 1 AS dir FROM (SELECT seed, dst AS node FROM {_SEEDS} JOIN d ON src = seed UNION SELECT seed, e.dst FROM {_SEEDS} JOIN d ON d.src = seed JOIN d e ON e.src = d.dst) WHERE node <> seed
  UNION ALL SELECT DISTINCT seed, node, 2 FROM (SELECT seed, dst AS node FROM {_SEEDS} JOIN u ON src = seed UNION SELECT seed, e.dst FROM {_SEEDS} JOIN u ON u.src = seed JOIN u e ON e.src = u.dst) WHERE node <> seed
  UNION ALL SELECT target_symbol_id, source_symbol_id, 3 FROM symbol_references WHERE target_symbol_id IN (SELECT seed FROM {_SEEDS})),
c AS (SELECT seed, node AS symbol_id, count(*) AS n FROM v WHERE node IN (SELECT id FROM symbols) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY n DESC, symbol_id) AS position FROM c) WHERE position <= 10""")
def g13_impact(g):
    return traverse.impact(g.calls, g.symbol_references, g.symbols, _seed_names(g), max_depth=2, limit=5, top=10)


# the same for whole tables: every callable is a seed, limits are the operators' defaults


def _callables(g) -> DataFrame:
    return g.symbols.where(F.col("type").isin(*lookup.CALLABLE)).select(F.col("id").alias("seed"))


def _coded_edges(g, src: str = "caller_id", dst: str = "callee_id") -> tuple[Iterator[DataFrame], DataFrame]:
    """The edges in parts, as numbers of ids (id, k), and ids."""
    graphs, ids, _ = g.coded(CODED)
    number = lambda c: F.expr(f"try_cast({c} as int)")
    return (s.calls.select(number(src).alias("src"), number(dst).alias("dst"), F.col("line").alias("ord")) for s in graphs), ids


def _numbers_of(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """The numbers of symbols (seed) as seed."""
    return ids.join(symbols.select(F.col("seed").alias("id")), "id", "left_semi").select(F.col("k").alias("seed"))


_ALL = "(SELECT id AS seed FROM symbols WHERE type IN ('function', 'method'))"


@query()
def g10_callgraph_all(g):
    edges, ids = _coded_edges(g)
    return preorder.call_trees(edges, _numbers_of(_callables(g), ids), ids)


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT callee_id AS src, caller_id AS dst FROM calls),
t AS (SELECT seed, seed AS node, 0 AS depth FROM {_ALL} UNION SELECT seed, dst, depth + 1 FROM t JOIN e ON src = node WHERE depth < 2)
SELECT seed, node, min(depth) AS depth FROM t GROUP BY ALL""")
def g11_callers_recursive_all(g):
    up, ids = _coded_edges(g, "callee_id", "caller_id")
    return walks.levels(up, _numbers_of(_callables(g), ids), ids, 2)


@query()
def g12_trace_call_path_all(g):
    edges, ids = _coded_edges(g)
    goals = g.symbols.where("type = 'method'").select(F.col("id").alias("seed"))
    return walks.paths_to_goals(edges, _numbers_of(_callables(g), ids), _numbers_of(goals, ids), ids, 3)


@query(f"""
WITH dn AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY ord, dst) AS n FROM (SELECT caller_id AS src, callee_id AS dst, min(line) AS ord FROM calls GROUP BY 1, 2)),
un AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY ord, dst) AS n FROM (SELECT callee_id AS src, caller_id AS dst, min(line) AS ord FROM calls GROUP BY 1, 2)),
d AS (SELECT src, dst FROM dn WHERE n <= 50), u AS (SELECT src, dst FROM un WHERE n <= 50), dh AS (SELECT DISTINCT src FROM dn WHERE n > 50), uh AS (SELECT DISTINCT src FROM un WHERE n > 50),
h AS (SELECT src AS seed FROM dh UNION SELECT src FROM uh UNION SELECT d.src FROM d JOIN dh ON dh.src = d.dst UNION SELECT u.src FROM u JOIN uh ON uh.src = u.dst),
v AS (
  SELECT DISTINCT seed, node, 1 AS dir FROM (SELECT seed, dst AS node FROM {_ALL} JOIN d ON src = seed UNION SELECT seed, e.dst FROM {_ALL} JOIN d ON d.src = seed JOIN d e ON e.src = d.dst) WHERE node <> seed
  UNION ALL SELECT DISTINCT seed, node, 2 FROM (SELECT seed, dst AS node FROM {_ALL} JOIN u ON src = seed UNION SELECT seed, e.dst FROM {_ALL} JOIN u ON u.src = seed JOIN u e ON e.src = u.dst) WHERE node <> seed
  UNION ALL SELECT target_symbol_id, source_symbol_id, 3 FROM symbol_references WHERE target_symbol_id IN (SELECT seed FROM {_ALL})),
c AS (SELECT seed, node AS symbol_id, count(*) AS n FROM v WHERE node IN (SELECT id FROM symbols) GROUP BY ALL)
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY seed) AS total, row_number() OVER (PARTITION BY seed ORDER BY n DESC, symbol_id) AS position, seed IN (SELECT seed FROM h) AS truncated FROM c) WHERE position <= 10""")
def g13_impact_all(g):
    return traverse.impact(g.calls, g.symbol_references, g.symbols, _callables(g), flags=True)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT target_symbol_id AS b, source_symbol_id AS d FROM symbol_references WHERE category = 'methodOverride' AND target_symbol_id <> source_symbol_id),
t AS (SELECT b, d, 1 AS n FROM e UNION SELECT t.b, e.d, n + 1 FROM t JOIN e ON e.b = t.d WHERE n < 16 AND t.b <> e.d)
SELECT DISTINCT b AS base_id, d AS derived_id FROM t""")
def d11_override_closure(g):
    return resolve.override_closure(g.symbol_references)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT source_file AS src, included_file AS dst FROM include_dependencies WHERE NOT is_system_include),
t AS (SELECT src AS source, src AS reached, 0 AS depth FROM e UNION SELECT source, dst, depth + 1 FROM t JOIN e ON src = reached WHERE depth < 10)
SELECT source, reached, min(depth) AS depth FROM t GROUP BY ALL HAVING source <> reached""")
def x15_include_closure(g):
    return traverse.include_closure(g.include_dependencies)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT source_file AS src, included_file AS dst FROM include_dependencies WHERE NOT is_system_include AND source_file <> included_file),
p AS (SELECT [src, dst] AS path FROM e WHERE src < dst UNION ALL SELECT list_append(path, dst) FROM p JOIN e ON src = path[-1] WHERE len(path) < 4 AND dst > path[1] AND NOT list_contains(path, dst))
SELECT DISTINCT array_to_string(path, '>') AS cycle, len(path) AS length FROM p JOIN e ON src = path[-1] AND dst = path[1]""")
def d24_include_cycles(g):
    return traverse.include_cycles(g.include_dependencies, max_length=4)


# ---- merging and resolution


_KEYS = f"""CASE WHEN coalesce(symbol_role, '') = 'definition' AND NOT {_HEADER.format(p='file_path')} THEN 4 WHEN symbol_role = 'definition' THEN 3 WHEN symbol_role = 'inline_definition' THEN 2 WHEN symbol_role = 'declaration' THEN 1 WHEN def_path IS NOT NULL AND NOT {_HEADER.format(p='file_path')} THEN 3 ELSE 0 END DESC,
  CASE WHEN {_IMPL.format(p='file_path')} THEN 2 WHEN {_HEADER.format(p='file_path')} THEN 1 ELSE 0 END DESC, CASE WHEN decl_path IS NOT NULL AND def_path IS NOT NULL THEN 2 WHEN def_path IS NOT NULL THEN 1 ELSE 0 END DESC, line, file_path, end_line"""
_RANK = f"""(CASE WHEN symbol_role = 'definition' AND NOT {_HEADER.format(p='file_path')} THEN 400 WHEN symbol_role IN ('definition', 'inline_definition') THEN 280 WHEN symbol_role = 'declaration' THEN 160 WHEN def_path IS NOT NULL AND NOT {_HEADER.format(p='file_path')} THEN 400 WHEN def_path IS NOT NULL THEN 280 ELSE 160 END
  + CASE WHEN artifact_kind = 'runtime' THEN 25 ELSE 0 END + CASE WHEN header_role = 'public' THEN 20 ELSE 0 END + CASE WHEN {_TEST} THEN 0 ELSE 10 END + CASE WHEN {_GEN} THEN 0 ELSE 10 END + CASE WHEN regexp_matches(lower(file_path), '[.]inl[.](hpp|h|hxx)$') THEN -30 ELSE 0 END)"""
_D1 = f"""
WITH l AS (SELECT *, CASE WHEN declaration_file_path IS NULL AND symbol_role = 'declaration' THEN file_path ELSE declaration_file_path END AS decl_path, CASE WHEN declaration_file_path IS NULL AND symbol_role = 'declaration' THEN line ELSE declaration_line END AS decl_line,
  CASE WHEN definition_file_path IS NULL AND symbol_role IN ('definition', 'inline_definition') THEN file_path ELSE definition_file_path END AS def_path, CASE WHEN definition_file_path IS NULL AND symbol_role IN ('definition', 'inline_definition') THEN line ELSE definition_line END AS def_line FROM symbols_raw),
r AS (SELECT *, {_RANK} AS rank FROM l), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank DESC, {_KEYS}) AS n FROM r),
f AS (SELECT id, arg_min(signature, (file_path, line)) FILTER (WHERE signature IS NOT NULL) AS signature, arg_min(subsystem, (file_path, line)) FILTER (WHERE subsystem IS NOT NULL) AS subsystem, arg_min(header_role, (file_path, line)) FILTER (WHERE header_role IS NOT NULL) AS header_role,
  arg_min(struct_pack(p := decl_path, l := decl_line), (file_path, line)) FILTER (WHERE decl_path IS NOT NULL) AS decl, arg_min(struct_pack(p := def_path, l := def_line), (file_path, line)) FILTER (WHERE def_path IS NOT NULL) AS def, arg_max(struct_pack(p := def_path, l := def_line), (file_path, line)) FILTER (WHERE def_path IS NOT NULL AND symbol_role = 'definition') AS last FROM l GROUP BY id)
SELECT o.id, o.file_path, o.line, o.symbol_role, coalesce(o.signature, f.signature) AS signature, coalesce(o.subsystem, f.subsystem) AS subsystem, coalesce(o.header_role, f.header_role) AS header_role, coalesce(o.decl_path, f.decl.p) AS declaration_file_path,
  coalesce(CASE WHEN o.decl_path IS NOT NULL THEN o.decl_line ELSE f.decl.l END, 0) AS declaration_line, coalesce(f.last.p, o.def_path, f.def.p) AS definition_file_path, coalesce(CASE WHEN f.last IS NOT NULL THEN f.last.l WHEN o.def_path IS NOT NULL THEN o.def_line ELSE f.def.l END, 0) AS definition_line, o.parse_fragility
FROM o JOIN f USING (id) WHERE n = 1"""
_MERGED = ["id", "file_path", "line", "symbol_role", "signature", "subsystem", "header_role", "declaration_file_path", "declaration_line", "definition_file_path", "definition_line", "parse_fragility"]


@query(_D1)
def d1_merge_symbols(g):
    return merge.merge_symbols(g.symbols_raw).select(*_MERGED).na.fill(0, ["declaration_line", "definition_line"])


@query(f"SELECT id, file_path, line, {_RANK} AS rank FROM (SELECT *, definition_file_path AS def_path FROM symbols_raw)")
def d2_representative_rank(g):
    return g.symbols_raw.select("id", "file_path", "line", merge.rank().alias("rank"))


@query("SELECT id, CASE WHEN declaration_file_path IS NULL AND symbol_role = 'declaration' THEN file_path ELSE declaration_file_path END AS declaration_file_path, CASE WHEN definition_file_path IS NULL AND symbol_role IN ('definition', 'inline_definition') THEN line ELSE coalesce(definition_line, 0) END AS definition_line FROM symbols_raw")
def d3_own_locations(g):
    return merge.with_own_locations(g.symbols_raw).select("id", "declaration_file_path", "definition_line").na.fill(0, ["definition_line"])


_SPACE = "CASE WHEN contains({n}, '::') THEN regexp_replace({n}, '::[^:]*$', '') END"
_FOLDER = "string_split(CASE WHEN contains({p}, '/') THEN regexp_replace({p}, '/[^/]*$', '') ELSE '' END, '/')"
_RESOLVE = f"""
WITH r AS (SELECT *, row_number() OVER () AS site_id FROM (SELECT DISTINCT caller_id, called_name, call_kind, argument_count, receiver, qualifier, qualifier_kind, pre_resolved_callee_id, file_path, line FROM raw_calls)),
c AS (
  SELECT r.*, s.id AS callee_id, s.type AS callee_type, s.parent_id, s.file_path AS callee_path, s.parameter_count, s.signature, s.header_role, {_SPACE.format(n='coalesce(s.parent_id, s.qualified_name)')} AS space, k.parent_id AS caller_parent, {_SPACE.format(n='coalesce(k.parent_id, k.qualified_name)')} AS caller_space,
    {_FOLDER.format(p='r.file_path')} AS a, {_FOLDER.format(p='s.file_path')} AS b
  FROM r JOIN symbols s ON s.name = r.called_name AND s.type IN ('function', 'method') LEFT JOIN symbols k ON k.id = r.caller_id WHERE pre_resolved_callee_id IS NULL),
h AS (SELECT *, len(a) + len(b) - 2 * (CASE WHEN a[1] IS DISTINCT FROM b[1] THEN 0 WHEN a[2] IS DISTINCT FROM b[2] THEN 1 WHEN a[3] IS DISTINCT FROM b[3] THEN 2 ELSE 3 END) AS hops FROM c),
m AS (SELECT *, CASE WHEN file_path = callee_path THEN -50 WHEN hops <= 2 THEN -30 WHEN hops <= 3 THEN hops * -8 WHEN hops <= 5 THEN hops * -15 ELSE hops * -30 END AS bonus0 FROM h),
x AS (SELECT *, max(bonus0) OVER (PARTITION BY site_id) AS near, max(CASE WHEN file_path = callee_path THEN 1 ELSE 0 END) OVER (PARTITION BY site_id) AS same FROM m),
y AS (SELECT *, CASE WHEN same = 1 THEN -50 ELSE near END AS bonus FROM x),
z AS (SELECT *, {_plus("call_kind <> 'qualified' AND parent_id = caller_parent", 100)} + {_plus("space = caller_space", 50)}
  + {_plus("call_kind IN ('memberAccess', 'pointerMemberAccess') AND callee_type = 'method'", 30)} + {_plus("call_kind = 'qualified' AND qualifier_kind = 'namespace' AND space = qualifier", 70)}
  + CASE WHEN parameter_count IS NOT NULL THEN {_plus("parameter_count = argument_count", 60)} ELSE {_plus(f"{_ARITY.format(s='signature')} = argument_count", 40)} END
  + CASE WHEN file_path = callee_path AND same = 1 THEN 40 WHEN bonus = -30 AND same = 0 THEN 25 WHEN bonus >= -24 AND bonus < 0 AND same = 0 THEN 10 ELSE 0 END + CASE WHEN file_path <> callee_path AND bonus < 0 THEN bonus ELSE 0 END
  + {_plus("header_role = 'public' AND " + _HEADER.format(p="callee_path"), 15)} + {_plus(_IMPL.format(p="callee_path"), 20)} AS score FROM y),
t AS (SELECT *, max(score) OVER (PARTITION BY site_id) AS top FROM z), u AS (SELECT *, count(*) OVER (PARTITION BY site_id) AS ties, row_number() OVER (PARTITION BY site_id ORDER BY callee_id) AS n FROM t WHERE score = top),
edges AS (SELECT caller_id, callee_id, file_path, line, 1 AS tier FROM u WHERE n = 1 AND (ties = 1 OR score > 0) UNION ALL SELECT caller_id, pre_resolved_callee_id, file_path, line, 0 FROM r WHERE pre_resolved_callee_id IN (SELECT id FROM symbols)),
resolved AS (SELECT caller_id, callee_id, file_path, line, min(tier) AS tier FROM edges WHERE caller_id <> callee_id GROUP BY ALL)"""


@query(_RESOLVE + " SELECT caller_id, callee_id, file_path, line, CASE tier WHEN 0 THEN 'compiler_confirmed' ELSE 'heuristic' END AS resolution_tier FROM resolved")
def d5_resolve_calls(g):
    graphs, ids, paths = g.coded()
    number = lambda c: F.expr(f"try_cast({c} as int)")
    given = F.when(F.col("pre_resolved_callee_id").isNotNull(), F.coalesce(number("pre_resolved_callee_id"), F.lit(-1)))  # 'gone' is no number
    raw = [s.raw_calls.withColumns({"caller_id": number("caller_id"), "pre_resolved_callee_id": given, "file_path": number("file_path")}) for s in graphs]
    names, files = ids.select("id", F.col("k").alias("id_k")), paths.select(F.col("id").alias("file_path"), F.col("k").alias("path_k"))
    symbols = g.symbols.join(names, "id").join(files, "file_path", "left").withColumn("path", F.col("file_path")).withColumns({"id": F.col("id_k"), "file_path": F.col("path_k")}).drop("id_k", "path_k")
    edges = resolve.resolve_calls(raw, symbols, g.symbol_references, files.select(F.col("path_k").alias("file_path"), F.col("file_path").alias("path")))
    return _decoded(traverse.cut(edges), {"caller_id": ids, "callee_id": ids, "file_path": paths})


def _decoded(df: DataFrame, texts: dict[str, DataFrame]) -> DataFrame:
    """df with the texts (id, k) of the numbers in some of its columns."""
    columns = df.columns
    for c, table in texts.items():
        df = df.join(traverse.shipped(table.select(F.col("id"), F.col("k")), table.count(), CODED), F.col(c) == F.col("k")).withColumn(c, F.col("id")).drop("id", "k")
    return df.select(*columns)


@query("SELECT called_name, count(*) AS n FROM raw_calls r JOIN symbols s ON s.name = r.called_name AND s.type IN ('function', 'method') GROUP BY 1")
def d4_candidate_counts(g):
    return resolve.candidate_counts(g.raw_calls, g.symbols)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT target_symbol_id AS b, source_symbol_id AS d FROM symbol_references WHERE category = 'methodOverride' AND target_symbol_id <> source_symbol_id),
t AS (SELECT b, d, 1 AS n FROM e UNION SELECT t.b, e.d, n + 1 FROM t JOIN e ON e.b = t.d WHERE n < 16 AND t.b <> e.d), o AS (SELECT DISTINCT b, d FROM t),
u AS (SELECT caller_id, callee_id, file_path, line, resolution_tier FROM calls UNION ALL SELECT caller_id, o.d, c.file_path, c.line, 'cha_virtual' FROM calls c JOIN symbols s ON s.id = callee_id AND symbol_role IN ('virtual', 'pure_virtual') JOIN o ON o.b = callee_id WHERE o.d <> caller_id)
SELECT caller_id, callee_id, file_path, line, CASE min(CASE resolution_tier WHEN 'compiler_confirmed' THEN 0 WHEN 'heuristic' THEN 1 ELSE 2 END) WHEN 0 THEN 'compiler_confirmed' WHEN 1 THEN 'heuristic' ELSE 'cha_virtual' END AS resolution_tier FROM u GROUP BY ALL""")
def d10_expand_virtual_calls(g):
    return resolve.expand_virtual(g.calls, g.symbols, resolve.override_closure(g.symbol_references))


@query("SELECT caller_id, callee_id, file_path, line, CASE min(CASE resolution_tier WHEN 'compiler_confirmed' THEN 0 WHEN 'heuristic' THEN 1 ELSE 2 END) WHEN 0 THEN 'compiler_confirmed' WHEN 1 THEN 'heuristic' ELSE 'cha_virtual' END AS resolution_tier FROM calls GROUP BY ALL")
def d12_distinct_edges(g):
    return resolve.distinct_edges(g.calls)


def _relation_events(g) -> DataFrame:
    return g.symbol_references.select(F.col("source_symbol_id").alias("source_id"), F.when(F.col("line") % 2 == 0, S.leaf(F.col("target_symbol_id"))).otherwise(F.col("target_symbol_id")).alias("target_name"), F.when(F.col("category").isin("functionCall", "methodCall"), "typeUsage").otherwise(F.col("category")).alias("category"), F.lit(None).cast("string").alias("namespace_hint"), "file_path", "line").distinct()


_EVENTS = "SELECT DISTINCT source_symbol_id AS source_id, CASE WHEN line % 2 = 0 THEN regexp_extract(target_symbol_id, '[^:]*$') ELSE target_symbol_id END AS target_name, CASE WHEN category IN ('functionCall', 'methodCall') THEN 'typeUsage' ELSE category END AS category, file_path, line FROM symbol_references"


@query(f"""
WITH ev AS ({_EVENTS}), keys AS (SELECT DISTINCT unnest([name, id, qualified_name]) AS target_name, id AS target_id, type, qualified_name, {_SPACE.format(n='coalesce(parent_id, qualified_name)')} AS space, parent_id FROM symbols),
f AS (SELECT ev.*, target_id, k.type, CASE WHEN category = 'enumValueUsage' THEN {_plus("k.space = " + _SPACE.format(n="coalesce(s.parent_id, s.qualified_name)"), 50)} ELSE {_plus("k.target_id = ev.target_name OR k.qualified_name = ev.target_name", 100)} + {_plus("k.space = " + _SPACE.format(n="coalesce(s.parent_id, s.qualified_name)"), 50)} END AS score
  FROM ev JOIN keys k USING (target_name) JOIN symbols s ON s.id = ev.source_id
  WHERE CASE category WHEN 'enumValueUsage' THEN k.type = 'enumMember' WHEN 'typeUsage' THEN k.type IN ('class', 'struct', 'enum', 'typedef') WHEN 'inheritanceMention' THEN k.type IN ('class', 'struct', 'enum', 'typedef') WHEN 'methodOverride' THEN k.target_id = ev.target_name ELSE true END),
n AS (SELECT *, count(*) OVER w AS n, max(score) OVER w AS best FROM f WINDOW w AS (PARTITION BY source_id, target_name, category, file_path, line)),
t AS (SELECT *, count(*) OVER (PARTITION BY source_id, target_name, category, file_path, line) AS ties FROM n WHERE score = best)
SELECT DISTINCT source_id AS source_symbol_id, target_id AS target_symbol_id, category, file_path, line FROM t WHERE (n = 1 OR (ties = 1 AND best > 0)) AND (category <> 'inheritanceMention' OR type IN ('class', 'struct'))""")
def d14_resolve_references(g):
    return resolve.resolve_references(_relation_events(g), g.symbols).select("source_symbol_id", "target_symbol_id", "category", "file_path", "line")


@query("SELECT r.source_symbol_id, r.target_symbol_id, r.category, r.line FROM symbol_references r JOIN symbols t ON t.id = target_symbol_id WHERE source_symbol_id IN (SELECT id FROM symbols) AND (category <> 'inheritanceMention' OR t.type IN ('class', 'struct'))")
def d17_persistable_references(g):
    return resolve.persistable(g.symbol_references, g.symbols).select("source_symbol_id", "target_symbol_id", "category", "line")


@query(f"WITH kept AS (SELECT * FROM ({_D1[_D1.index('WITH'):]})) SELECT id, file_path, line FROM kept")
def d29_partial_refresh(g):
    merged = merge.merge_symbols(g.symbols_raw)
    stale = merged.withColumn("file_path", F.when(F.col("type") == "class", F.lit("stale")).otherwise(F.col("file_path")))
    return merge.refresh(stale, g.symbols_raw, merged.where("type = 'class'")).select("id", "file_path", "line")


# ---- flow


_OWNER = "regexp_replace({a}, '::(param|local|return|expr|field|fieldexpr|arg)[^:]*(:.*)?$', '')"
_TOUCH = f"""
WITH ids AS (SELECT DISTINCT owner_symbol_id AS id FROM propagation_events),
i AS (SELECT i.id, 'incoming' AS side, e.* FROM ids i JOIN propagation_events e ON e.target_symbol_id = i.id OR {_OWNER.format(a='e.target_anchor_id')} = i.id OR (e.propagation_kind = 'argumentToParameter' AND e.owner_symbol_id = i.id)),
o AS (SELECT i.id, 'outgoing' AS side, e.* FROM ids i JOIN propagation_events e ON e.source_symbol_id = i.id OR {_OWNER.format(a='e.source_anchor_id')} = i.id OR e.owner_symbol_id = i.id),
touch AS (SELECT * FROM i UNION ALL SELECT * FROM o)"""


@query(_TOUCH + " SELECT id, side, source_anchor_id, target_anchor_id, propagation_kind, line FROM touch")
def g14_propagation(g):
    return flow.at_symbols(g.propagation_events, g.propagation_events.select(F.col("owner_symbol_id").alias("id"))).select("id", "side", "source_anchor_id", "target_anchor_id", "propagation_kind", "line")


@query(_TOUCH + """, k AS (SELECT id, side, propagation_kind, count(*) AS n FROM touch GROUP BY ALL), a AS (SELECT id, side, cast(sum(n) AS bigint) AS total, string_agg(propagation_kind || '=' || n, ',' ORDER BY propagation_kind) AS kinds FROM k GROUP BY ALL),
r AS (SELECT id, side, string_agg(DISTINCT risk, ',' ORDER BY risk) AS risks FROM (SELECT id, side, unnest(string_split(risk_text, ',')) AS risk FROM touch) WHERE risk <> '' GROUP BY ALL)
SELECT a.id, a.side, total, kinds, coalesce(risks, '') AS risks FROM a LEFT JOIN r ON r.id = a.id AND r.side = a.side""")
def g15_explain_propagation(g):
    return flow.explain(flow.at_symbols(g.propagation_events, g.propagation_events.select(F.col("owner_symbol_id").alias("id"))))


@query()
def g16_trace_variable_flow(g):
    return flow.trace(g.propagation_events, g.propagation_events.select(F.col("owner_symbol_id").alias("id")), 3, 50)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT source_anchor_id AS src, target_anchor_id AS dst FROM propagation_events), t AS (SELECT src AS first, dst AS last, 1 AS length FROM e UNION SELECT first, dst, length + 1 FROM t JOIN e ON src = last WHERE length < 3)
SELECT first, last, min(length) AS length FROM t GROUP BY ALL""")
def g16_flow_chains(g):
    return flow.chains(g.propagation_events, 3)


@query(_TOUCH + """, h AS (SELECT DISTINCT id AS node, CASE WHEN propagation_kind = 'argumentToParameter' THEN 'call' WHEN propagation_kind = 'returnValue' THEN 'return' WHEN propagation_kind IN ('fieldWrite', 'fieldRead') THEN 'field' ELSE 'local' END AS kind, file_path, line FROM touch)
SELECT *, row_number() OVER (PARTITION BY node ORDER BY file_path, line, kind) AS position FROM h""")
def g17_handoffs(g):
    return flow.handoffs(g.propagation_events, g.propagation_events.select(F.col("owner_symbol_id").alias("id")))


def _boundary(g) -> tuple[DataFrame, DataFrame, DataFrame]:
    names = g.symbols.select(F.col("id").alias("callee_id"), F.col("name").alias("callee_name"))
    calls = g.calls.join(names, "callee_id").select("caller_id", "callee_id", "callee_name", "file_path", "line").distinct()
    texts = F.when(F.col("argument_count") > 0, F.transform(F.sequence(F.lit(1), F.col("argument_count")), lambda k: F.when(k == 1, F.concat(F.lit("&"), "called_name")).otherwise(F.concat("called_name", F.lit("->x"))))).otherwise(F.array().cast("array<string>"))
    sites = g.raw_calls.select("caller_id", "called_name", texts.alias("argument_texts"), F.when(F.col("line") % 2 == 0, F.concat("caller_id", F.lit("::local:r@"), "line")).alias("result_anchor"), "file_path", "line").distinct()
    summaries = g.symbols.where("type in ('function', 'method') and parameter_count is not null").select(F.col("id").alias("callable_symbol_id"), F.when(F.col("parameter_count") > 0, F.transform(F.sequence(F.lit(1), F.col("parameter_count")), lambda k: F.concat("id", F.lit("::param:p"), k.cast("string")))).otherwise(F.array().cast("array<string>")).alias("parameters"), F.array(F.concat("id", F.lit("::return@1"))).alias("returns"))
    return calls, sites, summaries


_D18 = """
WITH c AS (SELECT DISTINCT caller_id, callee_id, s.name AS callee_name, c.file_path, c.line FROM calls c JOIN symbols s ON s.id = callee_id),
t AS (SELECT DISTINCT caller_id, called_name, argument_count, file_path, line, CASE WHEN line % 2 = 0 THEN caller_id || '::local:r@' || line END AS result_anchor FROM raw_calls)"""


@query(_D18 + """, p AS (SELECT c.*, called_name, argument_count, row_number() OVER (PARTITION BY c.caller_id, callee_id, c.file_path, c.line ORDER BY CASE WHEN called_name = callee_name THEN 0 ELSE 1 END, called_name, argument_count) AS n FROM c JOIN t ON t.caller_id = c.caller_id AND t.file_path = c.file_path AND t.line = c.line),
q AS (SELECT p.*, unnest(range(0, least(argument_count, parameter_count))) AS k FROM p JOIN symbols s ON s.id = callee_id AND parameter_count IS NOT NULL WHERE n = 1)
SELECT caller_id AS owner_symbol_id, k, callee_id || '::param:p' || (k + 1) AS target_anchor_id, file_path, line FROM q""")
def d18_argument_flow(g):
    calls, sites, summaries = _boundary(g)
    out = flow.argument_flow(calls, sites, summaries)
    return out.select("owner_symbol_id", F.regexp_extract("source_anchor_id", r"::arg(\d+)@", 1).cast("long").alias("k"), "target_anchor_id", "file_path", "line")


@query(_D18 + " SELECT DISTINCT c.caller_id AS owner_symbol_id, callee_id || '::return@1' AS source_anchor_id, result_anchor AS target_anchor_id, c.file_path, c.line FROM c JOIN t ON t.caller_id = c.caller_id AND t.file_path = c.file_path AND t.line = c.line AND called_name = callee_name JOIN symbols s ON s.id = callee_id AND parameter_count IS NOT NULL WHERE result_anchor IS NOT NULL")
def d19_return_flow(g):
    return flow.return_flow(*_boundary(g)).select("owner_symbol_id", "source_anchor_id", "target_anchor_id", "file_path", "line")


@query("""
WITH u AS (SELECT owner_symbol_id, coalesce(source_anchor_id, source_expression_text) AS source, coalesce(target_anchor_id, target_expression_text) AS target, propagation_kind, file_path, line, CASE WHEN confidence = 'high' THEN 0 ELSE 1 END AS c, risk_text FROM propagation_events)
SELECT owner_symbol_id, source, target, propagation_kind, file_path, line, CASE (min((c, risk_text)))[1] WHEN 0 THEN 'high' ELSE 'partial' END AS confidence, (min((c, risk_text)))[2] AS risk_text FROM u GROUP BY ALL""")
def d21_merge_propagation(g):
    return flow.merge_events(g.propagation_events, g.propagation_events)


# ---- incremental planning and upkeep


_PLAN = """plan AS (SELECT coalesce(d.path, s.path) AS path, CASE WHEN d.path IS NULL THEN 'removed_path' WHEN s.path IS NULL THEN 'new_path' WHEN d.content_hash = s.content_hash THEN 'unchanged_content' ELSE 'content_changed' END AS status FROM files d FULL JOIN stored_files s ON d.path = s.path)"""
_RENAMES = """gone AS (SELECT path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS n FROM stored_files WHERE path NOT IN (SELECT path FROM files)), fresh AS (SELECT path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS n FROM files WHERE path NOT IN (SELECT path FROM stored_files)),
hints AS (SELECT gone.path AS old_path, fresh.path AS new_path FROM gone JOIN fresh ON gone.content_hash = fresh.content_hash AND gone.n = fresh.n)"""


@query(f"WITH {_PLAN} SELECT * FROM plan")
def i1_plan(g):
    return incremental.plan(g.files, g.stored_files)


@query(f"WITH {_RENAMES} SELECT * FROM hints")
def i2_rename_hints(g):
    return incremental.rename_hints(g.files, g.stored_files)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT included_file AS src, source_file AS dst FROM include_dependencies WHERE NOT is_system_include), c AS (SELECT DISTINCT included_file AS path FROM include_dependencies WHERE included_file LIKE '%7'),
t AS (SELECT dst AS path, 1 AS depth FROM e JOIN c ON c.path = e.src UNION SELECT dst, depth + 1 FROM t JOIN e ON e.src = t.path WHERE depth < 64)
SELECT path, min(depth) AS depth FROM t WHERE path NOT IN (SELECT path FROM c) GROUP BY 1""")
def i3_header_fanout(g):
    changed = g.include_dependencies.where("included_file like '%7'").select(F.col("included_file").alias("path")).distinct()
    return incremental.header_fanout(g.include_dependencies, changed)


@query("""
WITH o AS (SELECT file_path, id, min(coalesce(signature, '')) AS was FROM symbols WHERE line % 5 <> 0 GROUP BY 1, 2), n AS (SELECT file_path, id, min(CASE WHEN line % 7 = 0 THEN 'new' ELSE coalesce(signature, '') END) AS now, bool_or(macro_sensitivity = 'high') AS macro FROM symbols WHERE line % 6 <> 0 GROUP BY 1, 2),
b AS (SELECT coalesce(o.file_path, n.file_path) AS file_path, o.id AS oid, n.id AS nid, was, now, macro FROM o FULL JOIN n ON o.file_path = n.file_path AND o.id = n.id),
g AS (SELECT file_path, count(*) FILTER (WHERE oid IS NULL) AS n_added, count(*) FILTER (WHERE nid IS NULL) AS n_removed, count(*) FILTER (WHERE was <> now) AS n_changed, coalesce(bool_or(macro), false) AS macro FROM b GROUP BY 1)
SELECT file_path, CASE WHEN macro THEN 'conservative' WHEN n_added + n_removed + n_changed = 0 THEN 'body_only' ELSE 'symbols_changed' END AS kind, n_added, n_removed, n_changed FROM g""")
def i4_header_change(g):
    before = g.symbols.where("line % 5 != 0")
    after = g.symbols.where("line % 6 != 0").withColumn("signature", F.when(F.col("line") % 7 == 0, "new").otherwise(F.col("signature")))
    return incremental.header_change(before, after)


@query("SELECT DISTINCT file_path FROM symbol_references WHERE target_symbol_id IN (SELECT id FROM symbols WHERE macro_sensitivity = 'high')")
def i5_narrow_impact(g):
    return incremental.narrow_impact(g.symbol_references, g.symbols.where("macro_sensitivity = 'high'"))


@query(f"WITH {_PLAN} SELECT * FROM plan WHERE contains(path, 'src1')")
def i6_plan_changed_paths(g):
    changed = g.files.select("path").union(g.stored_files.select("path")).where(F.col("path").contains("src1"))
    return incremental.plan_paths(g.files, g.stored_files, changed)


@query(f"""WITH {_PLAN}, {_RENAMES}, n AS (SELECT (SELECT count(*) FROM plan) AS n_files, (SELECT count(*) FROM plan WHERE status <> 'unchanged_content') AS n_changed, (SELECT count(*) FROM hints) AS n_renames)
SELECT *, n_renames >= CASE WHEN n_files > 5000 THEN ceil(50 * sqrt(n_files / 5000.0)) ELSE 50 END OR n_changed >= CASE WHEN n_files > 5000 THEN ceil(200 * sqrt(n_files / 5000.0)) ELSE 200 END OR (n_files >= 20 AND n_changed * 100 >= n_files * 40) AS escalate FROM n""")
def i7_escalation(g):
    return incremental.escalation(incremental.plan(g.files, g.stored_files), incremental.rename_hints(g.files, g.stored_files))


@query("""
WITH w AS (SELECT cast(floor(epoch(ts) / 3600) AS bigint) AS bucket, count(*) AS n FROM events GROUP BY 1)
SELECT a.bucket, a.n, a.n + coalesce(b.n, 0) AS rolled, a.n >= 64 OR a.n + coalesce(b.n, 0) >= 96 AS burst FROM w a LEFT JOIN w b ON b.bucket = a.bucket - 1""")
def i9_bursts(g):
    out = incremental.bursts(g.tool_calls.withColumnRenamed("called_at", "at"), files=1000, seconds=3600)
    return out.select(F.floor(F.unix_timestamp("bucket") / 3600).alias("bucket"), "n", "rolled", "burst")


@query("SELECT caller_id, callee_id, line FROM calls WHERE callee_id NOT IN (SELECT id FROM symbols WHERE symbol_role <> 'declaration')")
def d25_dangling_calls(g):
    return incremental.dangling_calls(g.calls, g.symbols.where("symbol_role != 'declaration'")).select("caller_id", "callee_id", "line")


@query("SELECT r.source_symbol_id, r.target_symbol_id, r.category, r.line FROM symbol_references r LEFT JOIN (SELECT * FROM symbols WHERE symbol_role <> 'virtual') t ON t.id = target_symbol_id WHERE t.id IS NULL OR source_symbol_id NOT IN (SELECT id FROM symbols WHERE symbol_role <> 'virtual') OR (category = 'inheritanceMention' AND t.type NOT IN ('class', 'struct'))")
def d26_dangling_references(g):
    return incremental.dangling_references(g.symbol_references, g.symbols.where("symbol_role != 'virtual'")).select("source_symbol_id", "target_symbol_id", "category", "line")


_KNOWN = "(SELECT DISTINCT owner_symbol_id FROM propagation_events WHERE line % 3 = 0)"


@query(f"SELECT owner_symbol_id, source_anchor_id, line FROM propagation_events WHERE owner_symbol_id NOT IN {_KNOWN} OR (source_symbol_id IS NOT NULL AND source_symbol_id NOT IN {_KNOWN}) OR (target_symbol_id IS NOT NULL AND target_symbol_id NOT IN {_KNOWN})")
def d27_dangling_propagation(g):
    known = g.propagation_events.where("line % 3 = 0").select(F.col("owner_symbol_id").alias("id")).distinct()
    return incremental.dangling_propagation(g.propagation_events, known).select("owner_symbol_id", "source_anchor_id", "line")


@query("SELECT caller_id, callee_id, file_path, line FROM calls WHERE file_path NOT IN (SELECT file_path FROM symbols WHERE artifact_kind = 'test')")
def d28_without_files(g):
    return incremental.without_files(g.calls, g.symbols.where("artifact_kind = 'test'").select(F.col("file_path").alias("path"))).select("caller_id", "callee_id", "file_path", "line")


@query("SELECT DISTINCT r.file_path FROM symbol_references r JOIN symbols s ON s.id = target_symbol_id WHERE s.artifact_kind = 'runtime'")
def d30_files_referring(g):
    return incremental.narrow_impact(g.symbol_references, g.symbols.where("artifact_kind = 'runtime'"))


@query("""
SELECT 'symbol_id_unique' AS rule, count(*) AS n FROM (SELECT id FROM symbols GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'symbol_has_name', count(*) FROM symbols WHERE name IS NULL OR name = '' UNION ALL SELECT 'end_after_line', count(*) FROM symbols WHERE end_line < line
UNION ALL SELECT 'callee_known', count(*) FROM calls WHERE callee_id NOT IN (SELECT id FROM symbols) UNION ALL SELECT 'reference_ends_known', count(*) FROM symbol_references r LEFT JOIN symbols t ON t.id = target_symbol_id WHERE t.id IS NULL OR source_symbol_id NOT IN (SELECT id FROM symbols) OR (category = 'inheritanceMention' AND t.type NOT IN ('class', 'struct'))""")
def s17_integrity(g):
    return incremental.integrity(g)


# ---- shapes


@query("WITH t AS (SELECT callee_id, count(DISTINCT caller_id) AS total FROM calls GROUP BY 1) SELECT callee_id, greatest(0, least(10, total - 5)) AS returned, total, total > 15 AS has_more, CASE WHEN total > 15 THEN 15 ELSE -1 END AS next_offset FROM t")
def r1_result_window(g):
    totals = g.calls.groupBy("callee_id").agg(F.count_distinct("caller_id").alias("total"))
    return totals.select("callee_id", shape.result_window(F.col("total"), 10, 5).alias("w")).select("callee_id", "w.*").na.fill(-1, ["next_offset"])


@query(f"""
WITH r AS (SELECT id, name, {_HEUR} AS score, {_BASE} AS base, file_path, line, qualified_name, artifact_kind, subsystem, module FROM symbols WHERE type IN ('function', 'method')),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, base DESC, file_path, line, qualified_name, id) AS rank, max(score) OVER (PARTITION BY name) AS top FROM r),
a AS (SELECT name, count(*) AS n, count(*) FILTER (WHERE score = top) AS n_top, string_agg(qualified_name, ',' ORDER BY rank) FILTER (WHERE rank <= 5) AS candidates, count(DISTINCT artifact_kind) AS d1, count(DISTINCT subsystem) AS d2, count(DISTINCT module) AS d3, count(DISTINCT file_path) AS d4 FROM k GROUP BY 1)
SELECT name, n, n_top, candidates, CASE WHEN greatest(d1, d2, d3, d4) <= 1 THEN NULL WHEN d1 = greatest(d1, d2, d3, d4) THEN 'artifact_kind' WHEN d2 = greatest(d1, d2, d3, d4) THEN 'subsystem' WHEN d3 = greatest(d1, d2, d3, d4) THEN 'module' ELSE 'file_path' END AS discriminator FROM a""")
def r7_ambiguity(g):
    return shape.ambiguity(lookup.ranked(g.symbols, lookup.CALLABLE))


@query("SELECT tool_name, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS n_errors, cast(sum(cast(elapsed_ms AS decimal(18, 2))) AS double) AS total_ms, max(called_at) AS last_at FROM tool_calls GROUP BY 1")
def r10_tool_stats(g):
    return shape.tool_stats(g.tool_calls)


@query("SELECT k, tool_name, called_at FROM tool_calls ORDER BY called_at DESC, k DESC LIMIT 20")
def r10_recent_calls(g):
    return shape.recent_calls(g.tool_calls)


@query("""
WITH p AS (SELECT DISTINCT file_path AS path, string_split(lower(file_path), '/') AS parts FROM symbols)
SELECT path, CASE WHEN parts[1] IN ('src', 'include') THEN 'runtime' ELSE parts[1] END AS subsystem, CASE WHEN parts[1] IN ('src', 'include') AND len(parts) > 1 THEN parts[2] ELSE parts[1] END AS module, 'runtime' AS artifact_kind,
  CASE WHEN contains(lower(path), 'ui') THEN 'ui' WHEN contains(lower(path), 'ai') THEN 'ai' END AS project_area, CASE WHEN ends_with(path, '.hpp') THEN CASE WHEN list_contains(parts, 'include') THEN 'public' ELSE 'private' END END AS header_role FROM p""")
def x21_path_metadata(g):
    p = F.col("path")
    return g.symbols.select(F.col("file_path").alias("path")).distinct().select("path", M.subsystem(p).alias("subsystem"), M.module(p).alias("module"), M.artifact_kind(p).alias("artifact_kind"), M.project_area(p).alias("project_area"), M.header_role(p).alias("header_role"))


# ---- sources and extraction


_LINES = "WITH l AS (SELECT path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM source_files)"


@query(f"""{_LINES} SELECT path AS source_file, CASE WHEN contains(text, '"') THEN regexp_extract(text, '"(.+)"', 1) ELSE regexp_extract(text, '<(.+)>', 1) END AS included_file, line, NOT contains(text, '"') AS is_system_include FROM l WHERE regexp_full_match(text, '#include ("[^"]+"|<[^>]+>)')""")
def x11_includes(g):
    return extract.includes(g.source_files)


@query(f"{_LINES} SELECT path AS file_path, regexp_extract(text, '#define (\\w+)', 1) AS name, CASE WHEN contains(text, '(') THEN 'x' ELSE split_part(text, ' ', 3) END AS value, line, CASE WHEN contains(text, '(') THEN 'functionLike' ELSE 'objectLike' END AS macro_type FROM l WHERE starts_with(text, '#define')")
def x12_macros(g):
    return extract.macros(g.source_files)


@query(f"{_LINES} SELECT path AS file_path, substr(text, 8) AS condition_text, line AS start_line, line + 4 AS end_line, false AS is_negated FROM l WHERE starts_with(text, '#ifdef') UNION ALL SELECT path, substr(text, 9), line, line + 2, true FROM l WHERE starts_with(text, '#ifndef')")
def x12_conditional_blocks(g):
    return extract.blocks(g.source_files)


@query(f"{_LINES} SELECT a.path AS file_path, CASE WHEN starts_with(b.text, 'struct') THEN 'S' ELSE regexp_extract(b.text, 'int (\\w+)', 1) END AS symbol_name, b.line, split_part(a.text, ' ', 2) AS gating_macro, starts_with(a.text, '#ifndef') AS is_negated FROM l a JOIN l b ON a.path = b.path WHERE (starts_with(a.text, '#ifdef') AND b.line = a.line + 2) OR (starts_with(a.text, '#ifndef') AND b.line = a.line + 1)")
def x13_conditional_symbols(g):
    return extract.conditional_symbols(g.source_files)


@query(f"""{_LINES}, c AS (SELECT path, count(*) FILTER (WHERE starts_with(text, '#')) AS m, count(*) FILTER (WHERE starts_with(text, '#include')) AS i, count(*) FILTER (WHERE starts_with(text, '#if') OR starts_with(text, '#elif')) AS c, count(*) FILTER (WHERE starts_with(text, '#define') AND contains(text, '(')) AS f FROM l GROUP BY path)
SELECT path, CASE WHEN m >= 12 OR c >= 4 OR f >= 3 OR i >= 25 THEN 'elevated' ELSE 'low' END AS parse_fragility, CASE WHEN m >= 12 OR c >= 4 OR f >= 3 THEN 'high' ELSE 'low' END AS macro_sensitivity, CASE WHEN i >= 15 THEN 'heavy' ELSE 'light' END AS include_heaviness FROM c""")
def x14_file_risks(g):
    return extract.risks(g.source_files)


@query("""WITH t AS (SELECT DISTINCT file_path AS path, line FROM calls)
SELECT t.path, t.line, arg_min(s.id, (s.end_line - s.line, s.id)) AS symbol_id FROM t LEFT JOIN symbols s ON s.file_path = t.path AND t.line BETWEEN s.line AND s.end_line GROUP BY ALL""")
def x16_enclosing_symbols(g):
    return extract.enclosing(g.calls.select(F.col("file_path").alias("path"), "line").distinct(), g.symbols)


@query()
def x1_scanned_sources(g):
    return extract.sightings(g.source_files.withColumn("language", F.lit("cpp")))


@query("SELECT path FROM files WHERE NOT regexp_matches(path, 'src1|[.]py$')")
def s2_not_ignored(g):
    return g.files.where(~trees.ignored(F.col("path"), ["# generated", "src1", "[.]py$", "("])).select("path")


@query("SELECT path, length(text) AS n, sha256(text) AS content_hash FROM source_files WHERE regexp_matches(path, '[.](cpp|h)$')")
def s5_hashed_sources(g):
    return g.source_files.where(S.extension(F.col("path")).isin("cpp", "h")).select("path", F.length("text").alias("n"), F.sha2("text", 256).alias("content_hash"))


@query()
def g17_investigate_workflow(g):
    # a row for every pair of a callable and a method, connected or not
    methods = g.symbols.where("type = 'method'").select("id")
    return investigate.coverage_between(g.propagation_events, g.calls, g.symbols, _callables(g).select(F.col("seed").alias("id")), methods, 3, 50, _coded_edges(g))

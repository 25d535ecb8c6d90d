"""Call resolution: scored candidates for every raw call, a tie rule, and the overrides of virtual callees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions import strings as S
from symloom.operators.lookup import CALLABLE
from symloom.operators.traverse import cut, ranked_rows, shipped

MAX_HOPS = 16


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def folder_bonus(source: Column, target: Column) -> Column:
    """How near a candidate's folder is to the caller's: at most 0."""
    a, b = F.split(source, "/"), F.split(target, "/")
    shorter = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, 1, shorter), F.slice(b, 1, shorter), lambda x, y: x == y), F.lit(False))
    common = F.when(differs == 0, shorter).otherwise(differs - 1)
    hops = F.size(a) + F.size(b) - 2 * common
    distance = F.when((source == target) & (source != ""), -1).when(hops <= 2, -1).when(hops <= 5, hops).otherwise(hops * 2)
    return F.when(distance < 0, -30).when(distance <= 3, distance * -8).otherwise(distance * -15)


def _space(qualified: Column, parent: Column) -> Column:
    """The namespace of a symbol: its parent's if it has one."""
    name = F.coalesce(parent, qualified)
    return F.when(name.contains("::"), F.regexp_replace(name, "::[^:]*$", ""))


def plus_if(condition: Column, points: int) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), points).otherwise(0)


#: What a call's candidates and their scores depend on, beside argument_texts.
SIGNATURE = ["called_name", "call_kind", "argument_count", "qualifier", "qualifier_kind", "caller_parent", "caller_space", "near", "same_path"]

#: Tables of so many rows of a few numbers are broadcast to calls (40 bytes each).
SMALL = 2_000_000


def _few(df: DataFrame) -> DataFrame:
    """df written down, broadcast if it is small."""
    df = cut(df)
    return shipped(df, df.count(), SMALL)


def _targets(symbols: DataFrame) -> DataFrame:
    """Callables by called_name, with what candidates are scored by; symbols may have path, the text of a file_path that is a number."""
    path = F.col("path") if "path" in symbols.columns else F.col("file_path")
    own = plus_if((F.col("header_role") == "public") & S.header(path), 15) + plus_if(S.implementation(path) & ~S.header(path), 20)
    own = own + plus_if(F.col("signature").contains("<") & F.col("signature").contains(">") & (F.col("name").contains("<") | F.col("name").contains(":")), 30)
    return symbols.where(F.col("type").isin(*CALLABLE)).select(
        F.col("name").alias("called_name"), F.col("id").alias("callee_id"), F.col("type").alias("callee_type"), "parent_id", F.col("file_path").alias("callee_path"), "parameter_count", "signature",
        S.arity(F.col("signature")).alias("arity"), S.leaf(F.col("parent_id")).alias("parent_leaf"), _space(F.col("qualified_name"), F.col("parent_id")).alias("space"), own.alias("own_score"),
    )


def signed(raw: DataFrame, symbols: DataFrame, targets: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """Raw calls of known callables' names with the columns of SIGNATURE.

    near is the bonus of the folder nearest to the caller's that has a callable of the name, same_path the caller's file
    if that has one itself. paths: the texts (path) of file_path where that is a number.
    """
    owner = symbols.select(F.col("id").alias("caller_id"), F.col("parent_id").alias("caller_parent"), _space(F.col("qualified_name"), F.col("parent_id")).alias("caller_space"))
    # few owners have many callers
    owners = cut(owner.select("caller_parent", "caller_space").distinct().withColumn("owner", F.monotonically_increasing_id()))
    same_owner = F.col("c.caller_parent").eqNullSafe(F.col("o.caller_parent")) & F.col("c.caller_space").eqNullSafe(F.col("o.caller_space"))
    caller = _few(owner.alias("c").join(owners.alias("o"), same_owner).select("c.caller_id", "o.owner"))
    targets = (_targets(symbols) if targets is None else targets).select("called_name", "callee_path")
    at = lambda df, c, folder: df.withColumn(folder, _folder(F.col(c)))
    between = (F.col("folder"), F.col("callee_folder"))
    if paths is not None:
        texts = ranked_rows(paths.select(_folder(F.col("path")).alias("id")).distinct())
        numbered = _few(paths.join(texts, _folder(F.col("path")) == F.col("id")).select(F.col("file_path").alias("at"), F.col("k").alias("number")))
        at = lambda df, c, folder: df.join(numbered, F.col(c) == F.col("at"), "left").withColumn(folder, F.col("number")).drop("at", "number")
    # how near the name's candidates are depends on the caller's folder and file alone
    folders = cut(at(raw.select("called_name", "file_path"), "file_path", "folder").select("called_name", "folder").distinct()).join(at(targets, "callee_path", "callee_folder").select("called_name", "callee_folder").distinct(), "called_name")
    # of any two folders the distance is worked out once, whatever the names
    apart = folders.select("folder", "callee_folder").distinct()
    if paths is not None:
        for c in ("folder", "callee_folder"):
            apart = apart.join(texts.select(F.col("k").alias(c), F.col("id").alias(f"{c}_text")), c)
        between = (F.col("folder_text"), F.col("callee_folder_text"))
    apart = apart.select("folder", "callee_folder", folder_bonus(*between).alias("bonus"))
    near = _few(folders.join(apart, ["folder", "callee_folder"]).groupBy("called_name", "folder").agg(F.max("bonus").alias("near")))
    same = _few(targets.select("called_name", F.col("callee_path").alias("file_path"), F.lit(True).alias("any_same")).distinct())
    sites = at(raw, "file_path", "folder").join(near, ["called_name", "folder"]).join(same, ["called_name", "file_path"], "left").withColumn("any_same", F.coalesce("any_same", F.lit(False)))
    sites = sites.withColumn("same_path", F.when(F.col("any_same"), F.col("file_path"))).join(caller, "caller_id", "left")
    return sites.join(F.broadcast(owners), "owner", "left").drop("owner")


def candidates(calls: DataFrame, symbols: DataFrame, references: DataFrame) -> DataFrame:
    """Every row of calls (the columns of SIGNATURE) with the callables of its name and their scores."""
    return _scored(calls, _targets(symbols), references)


def _scored(calls: DataFrame, targets: DataFrame, references: DataFrame, mine: bool | None = None) -> DataFrame:
    """calls with the targets of their names and the scores; mine: whether all targets are in the calls' own files, or none."""
    bases = references.where("category = 'inheritanceMention'").groupBy(F.col("source_symbol_id").alias("caller_parent")).agg(F.collect_set("target_symbol_id").alias("bases"))
    rows = calls.join(bases, "caller_parent", "left")
    rows = rows.join(targets, (rows["called_name"] == targets["called_name"]) & (rows["same_path"] == targets["callee_path"])).drop(targets["called_name"]) if mine else rows.join(targets, "called_name")
    plus = plus_if
    kind, any_same = F.col("call_kind"), F.col("same_path").isNotNull()
    mine = F.coalesce(F.col("same_path") == F.col("callee_path"), F.lit(False)) if mine is None else F.lit(mine)
    bonus = F.when(any_same, -50).otherwise(F.col("near"))
    direct, transitive = (bonus == -30) & ~any_same, (bonus >= -24) & (bonus < 0) & ~any_same
    score = (
        plus((kind != "qualified") & (F.col("parent_id") == F.col("caller_parent")), 100)
        + plus(F.col("space") == F.col("caller_space"), 50)
        + plus((kind != "qualified") & F.array_contains("bases", F.col("parent_id")), 90)
        + plus((kind == "thisPointerAccess") & (F.col("parent_id") == F.col("caller_parent")), 80)
        + plus(kind.isin("memberAccess", "pointerMemberAccess") & (F.col("callee_type") == "method"), 30)
        + plus((kind == "qualified") & (F.col("qualifier_kind") == "type") & ((F.col("parent_id") == F.col("qualifier")) | (F.col("parent_leaf") == F.col("qualifier"))), 90)
        + plus((kind == "qualified") & (F.col("qualifier_kind") == "namespace") & (F.col("space") == F.col("qualifier")), 70)
        + F.when(F.col("parameter_count").isNotNull(), plus(F.col("parameter_count") == F.col("argument_count"), 60)).otherwise(plus(F.col("arity") == F.col("argument_count"), 40))
        + F.when(mine, 40).when(direct, 25).when(transitive, 10).otherwise(0)
        + F.when(~mine & (bonus < 0), bonus).otherwise(0)
        + F.col("own_score")
    )
    if "argument_texts" in calls.columns:
        score = score + argument_hints(F.col("argument_texts"), F.col("signature"))
    return rows.withColumn("score", score)


def argument_hints(texts: Column, signature: Column) -> Column:
    """70 for each bool literal at a bool parameter, 90 for each argument whose last name is its parameter type's."""
    types = F.transform(F.split(F.regexp_extract(signature, r"(?s)\((.*)\)", 1), ","), lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), r"\b(const|volatile|struct|class|enum)\b|[&*]", ""), r"\s+\w+\s*$", ""))
    tail = lambda c: F.lower(F.regexp_replace(F.regexp_extract(F.trim(c), r"(\w+)\W*$", 1), "_", ""))

    def hint(argument: Column, wanted: Column) -> Column:
        literal = F.trim(argument).isin("true", "false")
        named = (tail(argument) != "") & (tail(argument) == tail(wanted))
        return F.when(F.lower(F.trim(wanted)) == "bool", F.when(literal, 70).otherwise(0)).when(named, 90).otherwise(0)

    both = F.least(F.size(texts), F.size(types))
    pairs = F.zip_with(F.slice(texts, 1, both), F.slice(types, 1, both), hint)
    return F.when(texts.isNull() | signature.isNull() | (F.size(texts) == 0), 0).otherwise(F.aggregate(pairs, F.lit(0), lambda a, x: a + x))


def candidate_counts(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """(called_name, n): the pairs of raw calls and callables of a name, counted without making them."""
    calls = raw.groupBy("called_name").agg(F.count(F.lit(1)).alias("calls"))
    known = symbols.where(F.col("type").isin(*CALLABLE)).groupBy(F.col("name").alias("called_name")).agg(F.count(F.lit(1)).alias("known"))
    return calls.join(known, "called_name").select("called_name", (F.col("calls") * F.col("known")).alias("n"))


def best_candidates(scored: DataFrame, key: str) -> DataFrame:
    """One candidate a key: the top score; of several at the top the smallest id, and only if the score is positive."""
    ties = F.sum("alike") if "alike" in scored.columns else F.count(F.lit(1))
    tied = scored.groupBy(key, "score").agg(ties.alias("ties"), F.min("callee_id").alias("callee_id"))
    top = tied.groupBy(key).agg(F.max_by(F.struct("score", "ties", "callee_id"), "score").alias("t"))
    return top.where("t.ties = 1 or t.score > 0").select(key, "t.callee_id", "t.score")


def resolve_calls(raw: DataFrame | list[DataFrame], symbols: DataFrame, references: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Call edges of raw calls: (caller_id, callee_id, file_path, line, resolution_tier).

    A callee that is given and known is confirmed; given but unknown, or the caller itself, gives no edge. Others go to
    the best-scored candidate. Equal edges count once, the confirmed first.

    raw is computed once and written down, names as numbers, part by part if it is a list. Ids and paths may be numbers too (in the order of what they
    stand for): symbols then have path, and paths is (file_path, path).
    """
    targets = cut(_targets(symbols))
    names = ranked_rows(targets.select(F.col("called_name").alias("id")).distinct()).select(F.col("id").alias("called_name"), F.col("k").alias("name"))
    named = lambda df, how: df.join(shipped(names, names.count()), "called_name", how).withColumn("called_name", F.col("name")).drop("name")
    parts = raw if isinstance(raw, list) else [raw]
    texts = [c for c in ("argument_texts",) if c in parts[0].columns]
    columns = ["caller_id", "called_name", "call_kind", "argument_count", *texts, "qualifier", "qualifier_kind", "pre_resolved_callee_id", "file_path", "line"]
    raw = reduce(DataFrame.unionByName, [cut(named(part.select(*columns), "left")) for part in parts])
    targets = cut(named(targets, "inner"))
    known = symbols.select(F.col("id").alias("pre_resolved_callee_id"))
    given = raw.where("pre_resolved_callee_id is not null").join(_few(known), "pre_resolved_callee_id", "left_semi")
    sure = given.select("caller_id", F.col("pre_resolved_callee_id").alias("callee_id"), "file_path", "line", F.lit(0).alias("tier"))
    open_calls = raw.where("pre_resolved_callee_id is null and called_name is not null").drop("pre_resolved_callee_id")
    sites = signed(open_calls, symbols, targets, paths)
    by = [*SIGNATURE, *texts]
    # calls that are alike are scored once
    alike = cut(sites.select(*by).distinct().withColumn("signature_id", F.monotonically_increasing_id()))
    # so are callables that are alike; their files count only where one is a call's own, and such a one scores 90 more than it does
    # among those of other files
    scored_by = [c for c in targets.columns if c not in ("callee_id", "callee_path")]
    scored_by = scored_by if texts else [c for c in scored_by if c != "signature"]
    groups = lambda more: targets.groupBy(*scored_by, *more).agg(F.min("callee_id").alias("callee_id"), F.count(F.lit(1)).alias("alike"))
    elsewhere, own = groups([]).withColumn("callee_path", F.lit(None)), groups(["callee_path"])
    kept = ["signature_id", "score", "alike", "callee_id"]
    signature = lambda df: df if texts else df.withColumn("signature", F.lit(None).cast("string"))
    scored = _scored(alike, signature(elsewhere), references, False).select(*kept).union(_scored(alike.where("same_path is not null"), signature(own), references, True).select(*kept))
    best = _few(alike.join(best_candidates(scored, "signature_id"), "signature_id").select(*by, "callee_id")).alias("b")
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}"))
    guessed = sites.alias("s").join(best, same).select("s.caller_id", "b.callee_id", "s.file_path", "s.line", F.lit(1).alias("tier"))
    return _distinct(sure.unionByName(guessed).where("caller_id != callee_id").repartition("caller_id", "callee_id"))


#: Tiers of an edge, the best first.
TIERS = ["compiler_confirmed", "heuristic", "cha_virtual"]


def _distinct(edges: DataFrame) -> DataFrame:
    """Edges (tier: its number) once each, with the name of the best tier."""
    named = F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("tier") + 1)
    return edges.groupBy("caller_id", "callee_id", "file_path", "line").agg(F.min("tier").alias("tier")).withColumn("resolution_tier", named).drop("tier")


def distinct_edges(calls: DataFrame) -> DataFrame:
    """Edges by caller, callee, file and line, each with its best tier: confirmed, heuristic, virtual."""
    order = F.when(F.col("resolution_tier") == "compiler_confirmed", 0).when(F.col("resolution_tier") == "heuristic", 1).otherwise(2)
    return calls.groupBy("caller_id", "callee_id", "file_path", "line").agg(F.min_by("resolution_tier", order).alias("resolution_tier"))


def override_closure(references: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(base_id, derived_id) over methodOverride edges, up to max_hops of them, never a method and itself."""
    edges = references.where("category = 'methodOverride'").select(F.col("target_symbol_id").alias("base_id"), F.col("source_symbol_id").alias("derived_id")).where("base_id != derived_id").distinct()
    reached, frontier = edges, edges
    step = edges.select(F.col("base_id").alias("derived_id"), F.col("derived_id").alias("next"))
    for _ in range(max_hops - 1):
        frontier = frontier.join(step, "derived_id").select("base_id", F.col("next").alias("derived_id")).where("base_id != derived_id").distinct()
        frontier = cut(frontier.join(reached, ["base_id", "derived_id"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    return reached


def expand_virtual(calls: DataFrame, symbols: DataFrame, closure: DataFrame) -> DataFrame:
    """Calls with an edge of tier cha_virtual to every override of a virtual callee, but the callee and the caller."""
    virtual = symbols.where(F.col("symbol_role").isin("virtual", "pure_virtual")).select(F.col("id").alias("callee_id"))
    seeds = calls.join(virtual, "callee_id", "left_semi").join(closure, F.col("callee_id") == F.col("base_id"))
    more = seeds.where("derived_id != caller_id").select("caller_id", F.col("derived_id").alias("callee_id"), "file_path", "line", F.lit("cha_virtual").alias("resolution_tier"))
    return distinct_edges(calls.unionByName(more))


def resolve_references(events: DataFrame, symbols: DataFrame) -> DataFrame:
    """Reference rows from relation events (source_id, target_name, category, namespace_hint, file_path, line).

    A target is found by name, id or qualified name among the types its category allows. One candidate is taken; of
    several the best scored, none if that is a tie or zero. Override targets go by id alone; references whose ends do
    not exist, and inheritance from anything but a class or struct, go.
    """
    keys = symbols.select(F.explode(F.array_distinct(F.array("name", "id", "qualified_name"))).alias("target_name"), F.col("id").alias("target_id"), "type", F.col("qualified_name").alias("target_qualified"), "parent_id", _space(F.col("qualified_name"), F.col("parent_id")).alias("target_space"))
    source = symbols.select(F.col("id").alias("source_id"), _space(F.col("qualified_name"), F.col("parent_id")).alias("source_space"))
    kinds = F.when(F.col("category") == "enumValueUsage", F.col("type") == "enumMember").when(F.col("category").isin("typeUsage", "inheritanceMention"), F.col("type").isin("class", "struct", "enum", "typedef")).when(F.col("category") == "methodOverride", F.col("target_id") == F.col("target_name")).otherwise(F.lit(True))
    # the space of a qualified name is the name before its leaf; of a member of an enum, the enum's
    enum = F.col("category") == "enumValueUsage"
    plus = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    general = plus((F.col("target_id") == F.col("target_name")) | (F.col("target_qualified") == F.col("target_name")), 100) + plus(F.col("target_space") == F.col("source_space"), 50) + plus(F.col("namespace_hint") == F.col("target_space"), 120)
    member = plus(F.col("namespace_hint") == F.col("parent_id"), 250) + plus(F.col("namespace_hint") == F.col("target_space"), 180) + plus(F.col("target_space") == F.col("source_space"), 50)
    found = events.join(keys, "target_name").where(kinds).join(source, "source_id").withColumn("score", F.when(enum, member).otherwise(general))
    per = ["source_id", "target_name", "category", "file_path", "line", "namespace_hint"]
    event = Window.partitionBy(*per)
    out = found.withColumn("n", F.count(F.lit(1)).over(event)).withColumn("best", F.max("score").over(event)).where("score = best").withColumn("ties", F.count(F.lit(1)).over(event)).where("n = 1 or (ties = 1 and best > 0)")
    return persistable(out.select(F.col("source_id").alias("source_symbol_id"), F.col("target_id").alias("target_symbol_id"), "category", "file_path", "line", F.lit("high").alias("confidence")).dropDuplicates(["source_symbol_id", "target_symbol_id", "category", "file_path", "line"]), symbols)


def persistable(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """References whose ends exist; inheritance only of classes and structs."""
    ends = references.join(symbols.select(F.col("id").alias("source_symbol_id")).distinct(), "source_symbol_id", "left_semi")
    types = symbols.select(F.col("id").alias("target_symbol_id"), F.col("type").isin("class", "struct").alias("_class")).distinct()
    return ends.join(types, "target_symbol_id").where("category != 'inheritanceMention' or _class").drop("_class").select(*references.columns)

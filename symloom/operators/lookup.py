"""Lookups of symbols: by name, id, scope and file; overviews and hierarchies. All answer for whole sets of seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions import strings as S

CALLABLE = ["function", "method"]
#: The scores of representatives and of heuristic candidates.
OUT_OF_LINE, INLINE, DECLARED = 400, 280, 160
FILTERS = ("subsystem", "module", "project_area", "artifact_kind", "header_role")


def by_name(symbols: DataFrame, seeds: DataFrame) -> DataFrame:
    """Symbols whose short name is in seeds (name)."""
    return symbols.join(seeds.select("name").distinct(), "name", "left_semi")


def by_id(symbols: DataFrame, seeds: DataFrame) -> DataFrame:
    """Symbols whose id is in seeds (id); repeated ids count once."""
    return symbols.join(seeds.select("id").distinct(), "id", "left_semi")


def filtered(symbols: DataFrame, **wanted: str | None) -> DataFrame:
    """Symbols that equal every given metadata value (FILTERS)."""
    for column, value in wanted.items():
        if value is not None:
            symbols = symbols.where(F.col(column) == value)
    return symbols


def representative_order() -> list[Column]:
    """What puts the representative of a qualified name first."""
    path = F.lower("file_path")
    aside = ["/test/", "/tests/", "/sample/", "/samples/", "/generated/"]
    keys = [(F.col("symbol_role") == "declaration") & (F.col("header_role") == "public"), F.col("symbol_role") == "definition", F.col("header_role") == "public"]
    bad = [S.ends_with_any(F.col("file_path"), S.INLINE_ENDS), S.any_of([path.contains(p) for p in aside])]
    return [*[F.when(k, 0).otherwise(1) for k in keys], *[F.when(k, 1).otherwise(0) for k in bad], F.col("file_path").asc(), F.col("line").asc(), F.col("id").asc()]


def by_qualified_name(symbols: DataFrame) -> DataFrame:
    """One symbol of each qualified name."""
    order = Window.partitionBy("qualified_name").orderBy(*representative_order())
    return symbols.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def sightings(symbols: DataFrame, raw: DataFrame) -> DataFrame:
    """All sightings of every id; the merged row of an id that has none."""
    return raw.unionByName(symbols.join(raw.select("id").distinct(), "id", "left_anti"))


def representative_score(inline_penalty: bool = False) -> Column:
    """How well a sighting stands for its symbol."""
    path, role = F.col("file_path"), F.coalesce("symbol_role", F.lit(""))
    first = F.when((role == "definition") & ~S.header(path), OUT_OF_LINE).when(
        role.isin("definition", "inline_definition") | (F.col("definition_file_path").isNotNull() & S.header(path)), INLINE
    ).otherwise(DECLARED)
    return first + (
        F.when(F.col("artifact_kind") == "runtime", 25).otherwise(0)
        + F.when(F.col("header_role") == "public", 20).otherwise(0)
        + F.when(S.test_like(path, F.col("artifact_kind")), 0).otherwise(10)
        + F.when(S.generated_like(path, F.col("artifact_kind")), 0).otherwise(10)
    )


def representative_report(symbols: DataFrame, raw: DataFrame) -> DataFrame:
    """Per id: sightings, the top score, how many reach it, and how canonical the representative is."""
    ranked = sightings(symbols, raw).withColumn("score", representative_score())
    top = ranked.withColumn("top", F.max("score").over(Window.partitionBy("id")))
    out = top.groupBy("id").agg(F.count(F.lit(1)).alias("n_sightings"), F.max("score").alias("top_score"), F.sum((F.col("score") == F.col("top")).cast("long")).alias("n_top"))
    level = F.when((F.col("top_score") >= OUT_OF_LINE) & (F.col("n_top") == 1), "canonical").when(F.col("top_score") >= INLINE, "acceptable").otherwise("weak")
    return out.withColumn("confidence", level)


def neighborhood(path: Column, context: str) -> Column:
    """30 for each common leading part of two paths, 10 for each common directory."""
    parts = F.filter(F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), lambda x: x != "")
    own = [p for p in context.replace("\\", "/").lower().split("/") if p]
    common, so_far = F.lit(0), F.lit(True)
    for k, part in enumerate(own):
        so_far = so_far & F.coalesce(F.try_element_at(parts, F.lit(k + 1)) == part, F.lit(False))
        common = common + F.when(so_far, 30).otherwise(0)
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return common + sum((F.when(F.array_contains(folders, p), 10).otherwise(0) for p in own[:-1]), F.lit(0))


def heuristic_score(language: str | None = None, subsystem: str | None = None, module: str | None = None, project_area: str | None = None, artifact_kind: str | None = None, file_path: str | None = None, scopes: tuple[str, ...] = (), neighbor: Column | None = None) -> Column:
    """The score of a same-name candidate, with what is known about the place that asks."""
    path, kind = F.col("file_path"), F.col("artifact_kind")
    depth = S.scope_depth(F.col("qualified_name"))
    score = (
        F.when(kind == "runtime", 20).when(kind == "editor", 10).otherwise(0)
        + F.when(S.test_like(path, kind), 0).otherwise(8)
        + F.when(S.generated_like(path, kind), 0).otherwise(8)
        + F.when(F.col("type") == "function", 8).otherwise(0)
        + F.when(S.implementation(path), 4).otherwise(0)
        + F.when(depth <= 1, 6).when(depth == 2, 2).otherwise(0)
    )
    if language:
        score = score + F.when(S.language(path) == language, 80).otherwise(0)
    for column, value, points in (("subsystem", subsystem, 120), ("module", module, 110), ("project_area", project_area, 90), ("artifact_kind", artifact_kind, 140)):
        if value:
            score = score + F.when(F.col(column) == value, points).otherwise(0)
    if file_path:
        score = score + neighborhood(path, file_path)
    if neighbor is not None:
        score = score + F.when(neighbor, 220).otherwise(0)
    if scopes:
        name = F.col("qualified_name")
        score = score + F.when(S.any_of([(name == s) | name.startswith(f"{s}::") for s in scopes]), 70).otherwise(0)
    return score


def ranked(symbols: DataFrame, types: list[str], **context) -> DataFrame:
    """Symbols of the types with score and rank among those of their name."""
    base = F.when((F.col("symbol_role") == "definition") & ~S.header(F.col("file_path")), OUT_OF_LINE).when(
        F.coalesce("symbol_role", F.lit("")).isin("definition", "inline_definition") | (F.col("definition_file_path").isNotNull() & S.header(F.col("file_path"))), INLINE
    ).otherwise(DECLARED)
    order = Window.partitionBy("name").orderBy(F.desc("score"), F.desc("_base"), "file_path", "line", "qualified_name", "id")
    out = symbols.where(F.col("type").isin(*types)).withColumn("score", heuristic_score(**context)).withColumn("_base", base)
    return out.withColumn("rank", F.row_number().over(order)).drop("_base")


def overloads(symbols: DataFrame) -> DataFrame:
    """Same-name callables grouped by type and qualified name: their number and ids in order of file, line and id."""
    entries = F.array_sort(F.collect_list(F.struct("file_path", "line", "id")))
    return symbols.where(F.col("type").isin(*CALLABLE)).groupBy("name", "type", "qualified_name").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(entries, lambda e: e["id"]), ",").alias("ids"))


def overview(symbols: DataFrame, owner: str, limit: int) -> DataFrame:
    """The first `limit` symbols of each owner (a column) by line, with the counts of all its types."""
    inside = symbols.where(F.col(owner).isNotNull())
    pairs = F.array_sort(F.collect_list(F.struct("type", "n")))
    counts = inside.groupBy(owner, "type").agg(F.count(F.lit(1)).alias("n")).groupBy(owner).agg(F.sum("n").alias("total"), F.array_join(F.transform(pairs, lambda p: F.concat(p["type"], F.lit("="), p["n"].cast("string"))), ",").alias("type_counts"))
    order = Window.partitionBy(owner).orderBy("line", "end_line", "qualified_name", "id")
    page = inside.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    return page.join(counts, owner).select(F.col(owner).alias("owner"), "position", "id", "type", "total", "type_counts", (F.col("total") > limit).alias("truncated"))


def override_candidates(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """(base_id, derived_id, confidence): methods of one name in a class and a direct base of it."""
    methods = symbols.where("type = 'method' and parent_id is not null")
    edges = references.where("category = 'inheritanceMention'").select("source_symbol_id", "target_symbol_id").distinct()
    derived, base = methods.alias("d"), methods.alias("b")
    joined = derived.join(edges.alias("e"), F.col("d.parent_id") == F.col("e.source_symbol_id")).join(base, (F.col("e.target_symbol_id") == F.col("b.parent_id")) & (F.col("d.name") == F.col("b.name")))
    same = (F.col("d.parameter_count") == F.col("b.parameter_count")) | (S.arity(F.col("d.signature")) == S.arity(F.col("b.signature")))
    return joined.select(F.col("b.id").alias("base_id"), F.col("d.id").alias("derived_id"), F.when(F.coalesce(same, F.lit(False)), "high").otherwise("partial").alias("confidence"))


def type_hierarchy(symbols: DataFrame, references: DataFrame, limit: int) -> DataFrame:
    """(id, side, related_id): bases, then derived types, at most `limit` in all for each type."""
    edges = references.where("category = 'inheritanceMention'").select("source_symbol_id", "target_symbol_id").distinct()
    known = symbols.select(F.col("id").alias("related_id"), "qualified_name")
    bases = edges.select(F.col("source_symbol_id").alias("id"), F.lit(0).alias("side"), F.col("target_symbol_id").alias("related_id"))
    derived = edges.select(F.col("target_symbol_id").alias("id"), F.lit(1).alias("side"), F.col("source_symbol_id").alias("related_id"))
    order = Window.partitionBy("id").orderBy("side", "qualified_name", "related_id")
    out = bases.union(derived).join(known, "related_id").withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    return out.select("id", F.when(F.col("side") == 0, "base").otherwise("derived").alias("side"), "related_id", "position")


def workspace_summary(files: DataFrame) -> DataFrame:
    return files.groupBy(S.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("symbol_count").alias("n_symbols"))


def index_details(graph) -> DataFrame:
    """One row: the tables' rows and the files at risk."""
    counts = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in (("n_symbols", graph.symbols), ("n_calls", graph.calls), ("n_references", graph.symbol_references), ("n_propagation", graph.propagation_events))]
    risk = graph.files.agg(F.count(F.lit(1)).alias("n_files"), *[F.sum((F.col(c) == v).cast("long")).alias(n) for n, c, v in (("n_fragile", "parse_fragility", "elevated"), ("n_macro", "macro_sensitivity", "high"), ("n_heavy", "include_heaviness", "heavy"))])
    for one in counts:  # one row each
        risk = risk.crossJoin(one)
    return risk


def metadata_groups(symbols: DataFrame, column: Column) -> DataFrame:
    """Distinct symbols by a metadata value; missing values do not count."""
    return symbols.dropDuplicates(["id"]).withColumn("key", column).where("key is not null and key != ''").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def search(symbols: DataFrame, text: str, types: list[str] | None = None, limit: int = 50, offset: int = 0, **wanted: str | None) -> DataFrame:
    """A page of the symbols with text in name or qualified name, whatever the case, with the total; under three characters nothing."""
    if len(text) < 3:
        return symbols.where("false").select("id", F.lit(0).alias("position"), F.lit(0).alias("total"))
    found = filtered(symbols, **wanted).where(F.lower("name").contains(text.lower()) | F.lower("qualified_name").contains(text.lower()))
    if types:
        found = found.where(F.col("type").isin(*types))
    page = found.select("id", "qualified_name").orderBy("qualified_name", "id").offset(offset).limit(limit)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    numbered = page.withColumn("position", F.row_number().over(Window.orderBy("qualified_name", "id")) + offset)  # at most `limit` rows
    return numbered.crossJoin(total).select("id", "position", "total")


def trigrams(symbols: DataFrame) -> DataFrame:
    """(gram, id): the three-letter runs of each symbol's lower-cased name and qualified name."""
    grams = lambda c: F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda k: F.substring(F.lower(c), k, 3))).otherwise(F.array().cast("array<string>"))
    return symbols.select("id", F.explode(F.array_union(grams(F.col("name")), grams(F.col("qualified_name")))).alias("gram")).select("gram", "id")


def search_indexed(symbols: DataFrame, index: DataFrame, text: str) -> DataFrame:
    """Ids whose names have text, found by its trigrams first."""
    lowered = text.lower()
    wanted = sorted({lowered[k : k + 3] for k in range(len(lowered) - 2)})
    ids = index.where(F.col("gram").isin(*wanted)).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("id")
    names = symbols.join(ids, "id", "left_semi")
    return names.where(F.lower("name").contains(lowered) | F.lower("qualified_name").contains(lowered)).select("id")

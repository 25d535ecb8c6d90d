"""Entity resolution: the sightings of an id become one symbol."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions import strings as S
from symloom.operators.lookup import DECLARED, INLINE, OUT_OF_LINE
from symloom.schema import SYMBOL_COLUMNS

_LOCATIONS = ("declaration", "definition")
_PLACE = ("file_path", "line", "end_line")
#: Taken from the representative alone.
_OWN = ("id", "name", "qualified_name", "type", "file_path", "line", "end_line", "symbol_role", "parse_fragility", "macro_sensitivity", "include_heaviness")


@dataclass(frozen=True)
class Rules:
    """A repository's own preferences."""

    preferred_prefixes: tuple[str, ...] = ()
    demoted_prefixes: tuple[str, ...] = ()
    artifact_kinds: tuple[str, ...] = ()
    header_roles: tuple[str, ...] = ()

    def score(self) -> Column:
        path = F.col("file_path")
        parts = [
            F.when(S.any_of([path.startswith(p) for p in self.preferred_prefixes]), 40).otherwise(0),
            F.when(S.any_of([path.startswith(p) for p in self.demoted_prefixes]), -40).otherwise(0),
            F.when(F.col("artifact_kind").isin(*self.artifact_kinds), 20).otherwise(0) if self.artifact_kinds else F.lit(0),
            F.when(F.col("header_role").isin(*self.header_roles), 15).otherwise(0) if self.header_roles else F.lit(0),
        ]
        return sum(parts[1:], parts[0])


def rank(rules: Rules | None = None) -> Column:
    """How well a sighting represents its symbol."""
    path, role = F.col("file_path"), F.coalesce("symbol_role", F.lit(""))
    header, defined = S.header(path), F.col("definition_file_path").isNotNull()
    score = F.when((role == "definition") & ~header, OUT_OF_LINE).when(role.isin("definition", "inline_definition"), INLINE).when(role == "declaration", DECLARED).when(defined & ~header, OUT_OF_LINE).when(defined, INLINE).otherwise(DECLARED)
    score = score + F.when(F.col("artifact_kind") == "runtime", 25).otherwise(0) + F.when(F.col("header_role") == "public", 20).otherwise(0)
    score = score + F.when(S.test_like(path, F.col("artifact_kind")), 0).otherwise(10) + F.when(S.generated_like(path, F.col("artifact_kind")), 0).otherwise(10)
    score = score + F.when(S.ends_with_any(path, S.INLINE_ENDS), -30).otherwise(0)
    return score + (rules or Rules()).score()


def tie_key() -> list[Column]:
    """Larger wins, after rank and before path and line."""
    path, role = F.col("file_path"), F.coalesce("symbol_role", F.lit(""))
    header, defined = S.header(path), F.col("definition_file_path").isNotNull()
    return [
        F.when((role == "definition") & ~header, 4).when(role == "definition", 3).when(role == "inline_definition", 2).when(role == "declaration", 1).when(defined & ~header, 3).otherwise(0),
        F.when(S.implementation(path), 2).when(header, 1).otherwise(0),
        F.when(F.col("declaration_file_path").isNotNull() & defined, 2).when(defined, 1).otherwise(0),
        -F.col("line"),
    ]


def with_own_locations(raw: DataFrame) -> DataFrame:
    """A declaration's or definition's own place where its location is missing."""
    for which, roles in (("declaration", ("declaration",)), ("definition", ("definition", "inline_definition"))):
        missing = F.col(f"{which}_file_path").isNull() & F.col("symbol_role").isin(*roles)
        raw = raw.withColumns({f"{which}_{p}": F.when(missing, F.col(p)).otherwise(F.col(f"{which}_{p}")) for p in _PLACE})
    return raw


def merge_symbols(raw: DataFrame, rules: Rules | None = None) -> DataFrame:
    """One row an id: the representative, with what it lacks from the first sighting by path and line that has it.

    A definition's location is that of the last sighting with role definition, if there is one. One aggregation, with
    partial results in each task.
    """
    optional = [c for c in SYMBOL_COLUMNS if c not in _OWN and not c.startswith(_LOCATIONS)]
    placed = with_own_locations(raw)
    order = F.struct((-rank(rules)).alias("rank"), *[(-k).alias(f"k{n}") for n, k in enumerate(tie_key())], F.col("file_path").alias("p"), F.col("line").alias("l"), F.col("end_line").alias("e"))
    best = F.min_by(F.struct(*SYMBOL_COLUMNS), order)
    at = [F.col("file_path").alias("_p"), F.col("line").alias("_l")]
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(*at, F.col(c).alias("v"))))
    where = lambda w: F.min(F.when(F.col(f"{w}_file_path").isNotNull(), F.struct(*at, *[F.col(f"{w}_{p}").alias(p) for p in _PLACE])))
    last = F.max(F.when((F.col("symbol_role") == "definition") & F.col("definition_file_path").isNotNull(), F.struct(*at, *[F.col(f"definition_{p}").alias(p) for p in _PLACE])))
    out = placed.groupBy("id").agg(best.alias("best"), *[first(c).alias(f"first_{c}") for c in optional], *[where(w).alias(f"first_{w}") for w in _LOCATIONS], last.alias("last_definition"))
    columns = {c: F.col(f"best.{c}") for c in _OWN} | {c: F.coalesce(f"best.{c}", f"first_{c}.v") for c in optional}
    for p in _PLACE:
        columns[f"declaration_{p}"] = F.when(F.col("best.declaration_file_path").isNotNull(), F.col(f"best.declaration_{p}")).otherwise(F.col(f"first_declaration.{p}"))
        columns[f"definition_{p}"] = F.when(F.col("last_definition").isNotNull(), F.col(f"last_definition.{p}")).when(F.col("best.definition_file_path").isNotNull(), F.col(f"best.definition_{p}")).otherwise(F.col(f"first_definition.{p}"))
    return out.select(*[columns[c].alias(c) for c in SYMBOL_COLUMNS])


def refresh(symbols: DataFrame, raw: DataFrame, ids: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The merged symbols with those of ids (id) made anew."""
    again = merge_symbols(raw.join(ids.select("id").distinct(), "id", "left_semi"), rules)
    return symbols.join(ids.select("id").distinct(), "id", "left_anti").unionByName(again)

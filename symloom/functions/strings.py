"""Column expressions over names and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension -> language; others count as cpp. Fixed values.
LANGUAGES = {"lua": "lua", "py": "python", "ts": "typescript", "tsx": "typescript", "rs": "rust"}
#: What marks test, sample and generated paths, headers and implementation files.
TEST_PARTS = ["/test/", "/tests/", "/spec/", "/specs/", "/sample/", "/samples/", "/benchmark/", "/benchmarks/", "_test.", ".test."]
GENERATED_PARTS = ["/generated/", "/gen/", "/autogen/"]
HEADER_ENDS = [".h", ".hh", ".hpp", ".hxx", ".inl", ".inc"]
IMPLEMENTATION_ENDS = [".c", ".cc", ".cpp", ".cxx", ".m", ".mm"]
INLINE_ENDS = [".inl.hpp", ".inl.h", ".inl.hxx"]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def language(path: Column) -> Column:
    ext = extension(path)
    return reduce(lambda chain, item: chain.when(ext == item[0], item[1]), LANGUAGES.items(), F.when(F.lit(False), "")).otherwise("cpp")


def ends_with_any(path: Column, ends: list[str]) -> Column:
    return any_of([F.lower(path).endswith(e) for e in ends])


def test_like(path: Column, artifact: Column) -> Column:
    return F.coalesce(artifact == "test", F.lit(False)) | any_of([F.lower(path).contains(p) for p in TEST_PARTS])


def generated_like(path: Column, artifact: Column) -> Column:
    return F.coalesce(artifact == "generated", F.lit(False)) | any_of([F.lower(path).contains(p) for p in GENERATED_PARTS])


def header(path: Column) -> Column:
    return ends_with_any(path, HEADER_ENDS)


def implementation(path: Column) -> Column:
    return ends_with_any(path, IMPLEMENTATION_ENDS)


def scope_parts(name: Column) -> Column:
    return F.split(name, "::", -1)


def scope_depth(name: Column) -> Column:
    return F.size(scope_parts(name)) - 1


def leaf(name: Column) -> Column:
    return F.element_at(scope_parts(name), -1)


def scope_prefixes(name: Column) -> Column:
    """a::b::c -> [a, a::b]."""
    parts = scope_parts(name)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "::"))).otherwise(F.array().cast("array<string>"))


def namespace(name: Column, scope_kind: Column, scope: Column) -> Column:
    """The namespace of a callable: its scope if that is a namespace, else its name without the leaf; null without one."""
    return F.when((scope_kind == "namespace") & scope.isNotNull(), scope).when(scope_depth(name) > 0, F.regexp_replace(name, "::[^:]*$", ""))


def within_scope(qualifier: Column, scope: Column) -> Column:
    """Equal, or one the tail of the other at "::", white space apart; false where either is missing."""
    return tight_within(tight(qualifier), tight(scope))


def tight(name: Column) -> Column:
    return F.regexp_replace(name, r"\s+", "")


def tight_within(q: Column, s: Column) -> Column:
    """within_scope of names without white space."""
    found = (q == s) | s.endswith(F.concat(F.lit("::"), q)) | q.endswith(F.concat(F.lit("::"), s))
    return F.coalesce(found & (q != "") & (s != ""), F.lit(False))


def plain_name(name: Column) -> Column:
    """Lower-cased letters and digits without a leading m_ or p_; null for none."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "(?i)^[mp]_?", ""), "[^a-zA-Z0-9]+", ""))


def names_alike(receiver: Column, owner: Column) -> Column:
    return plain_alike(plain_name(receiver), plain_name(owner))


def plain_alike(r: Column, o: Column) -> Column:
    """names_alike of plain names."""
    return F.coalesce((r != "") & (o != "") & (r.endswith(o) | o.endswith(r)), F.lit(False))


def directory(path: Column) -> Column:
    """Null for a path without one."""
    cut = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(path.contains("/") & (cut != ""), cut)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")


def arity(signature: Column) -> Column:
    """Parameters between the first "(" and the last ")"; blank or void is none; null without parentheses."""
    inside = F.trim(F.regexp_extract(signature, r"(?s)\((.*)\)", 1))
    has = signature.rlike(r"(?s)\(.*\)")
    return F.when(has, F.when((inside == "") | (inside == "void"), 0).otherwise(F.size(F.split(inside, ",", -1))))

"""What a path says about a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from symloom.functions.strings import any_of

#: First folder -> subsystem, and what marks areas of a project, in order.
SUBSYSTEMS = {
    "runtime": ["src", "source", "include", "public", "private", "internal"],
    "editor": ["editor", "editors"],
    "tools": ["tools", "tool"],
    "tests": ["tests", "test", "spec", "specs"],
    "generated": ["generated", "gen", "autogen"],
    "modules": ["modules", "module"],
    "plugins": ["plugins", "plugin"],
}
AREAS = [
    ("gameplay", "gameplay"), ("ui", "ui"), ("network", "networking"), ("net", "networking"), ("ai", "ai"), ("render", "rendering"), ("renderer", "rendering"),
    ("graphics", "rendering"), ("audio", "audio"), ("sound", "audio"), ("physics", "physics"), ("editor", "editor"), ("tool", "tools"), ("tools", "tools"),
    ("test", "tests"), ("tests", "tests"), ("generated", "generated"), ("engine", "engine"), ("core", "core"),
]


def _parts(path: Column) -> Column:
    return F.filter(F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), lambda p: p != "")


def _has(parts: Column, *names: str) -> Column:
    return any_of([F.array_contains(parts, n) for n in names])


def subsystem(path: Column) -> Column:
    first = F.try_element_at(_parts(path), F.lit(1))
    out = F.when(F.lit(False), "")
    for name, folders in SUBSYSTEMS.items():
        out = out.when(first.isin(*folders), name)
    return out.otherwise(first)


def module(path: Column) -> Column:
    parts = _parts(path)
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    inner = [*SUBSYSTEMS["modules"], *SUBSYSTEMS["plugins"], *SUBSYSTEMS["runtime"]]
    return F.when(first.isin(*inner) & second.isNotNull(), second).otherwise(first)


def artifact_kind(path: Column) -> Column:
    parts, lower = _parts(path), F.lower(path)
    return F.when(_has(parts, *SUBSYSTEMS["generated"]), "generated").when(_has(parts, *SUBSYSTEMS["tests"]) | lower.contains("_test.") | lower.contains(".test."), "test").when(_has(parts, *SUBSYSTEMS["editor"]), "editor").when(_has(parts, *SUBSYSTEMS["tools"]), "tool").otherwise("runtime")


def project_area(path: Column) -> Column:
    """The first area whose word is anywhere in the path; null for none."""
    lower = F.lower(path)
    out = F.when(F.lit(False), "")
    for word, area in AREAS:
        out = out.when(lower.contains(word), area)
    return out


def header_role(path: Column) -> Column:
    parts = _parts(path)
    is_header = F.lower(F.regexp_extract(path, r"([^./]*)$", 1)).isin("h", "hh", "hpp", "hxx", "inl", "inc") & path.contains(".")
    return F.when(is_header, F.when(_has(parts, "public", "include"), "public").when(_has(parts, "private", "src", "source"), "private").otherwise("internal"))

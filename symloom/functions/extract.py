"""From source text to rows: directives by column expressions, symbols and calls by scanners in Arrow batches.

The scanners know lines, strings, comments, indentation and braces, not whole grammars: templates are unwrapped to
their names, macros are not expanded, and lists of arguments are cut at top-level commas.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CONDITION = r"^\s*#\s*(ifdef|ifndef|if|elif|endif)\b\s*(.*?)\s*$"


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text): the lines of files (path, text)."""
    return files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("n", "text")).select("path", (F.col("n") + 1).cast("int").alias("line"), "text")


def includes(files: DataFrame) -> DataFrame:
    """include_dependencies: lines that are an include of "x" or <x> and nothing after it."""
    text = F.trim("text")
    name = F.regexp_extract(text, r'^#\s*include\s*(?:"([^"]+)"|<([^>]+)>)$', 1)
    system = F.regexp_extract(text, r'^#\s*include\s*(?:"([^"]+)"|<([^>]+)>)$', 2)
    found = lines(files).select(F.col("path").alias("source_file"), F.when(name != "", name).otherwise(system).alias("included_file"), "line", (system != "").alias("is_system_include"))
    return found.where("included_file != ''")


def macros(files: DataFrame) -> DataFrame:
    """macro_definitions: objectLike, functionLike, and conditionalDefine inside a conditional block."""
    pattern = r"^\s*#\s*define\s+(\w+)(\([^)]*\))?\s*(.*?)\s*$"
    found = lines(files).where(F.col("text").rlike(pattern)).select(F.col("path").alias("file_path"), F.regexp_extract("text", pattern, 1).alias("name"), F.nullif(F.regexp_extract("text", pattern, 3), F.lit("")).alias("value"), "line", (F.regexp_extract("text", pattern, 2) != "").alias("_call"))
    inside = blocks(files).select("file_path", "start_line", "end_line")
    guarded = found.join(inside, "file_path").where("line > start_line and line < end_line").select("file_path", "line", F.lit(True).alias("_in")).distinct()
    kind = F.when(F.col("_call"), "functionLike").when(F.col("_in"), "conditionalDefine").otherwise("objectLike")
    return found.join(guarded, ["file_path", "line"], "left").select("file_path", "name", "value", "line", kind.alias("macro_type"))


def blocks(files: DataFrame) -> DataFrame:
    """conditional_blocks: from #ifdef or #ifndef to the #endif that closes it; a plain #if takes its #endif along.

    Nesting is a running sum over a file's directives, and a block ends at the first #endif of its depth after it.
    """
    found = lines(files).select("path", "line", F.regexp_extract("text", _CONDITION, 1).alias("word"), F.regexp_extract("text", _CONDITION, 2).alias("rest")).where("word in ('ifdef', 'ifndef', 'if', 'endif')")
    step = F.when(F.col("word") == "endif", -1).otherwise(1)
    in_file = Window.partitionBy("path").orderBy("line")
    depth = F.sum(step).over(in_file) + F.when(F.col("word") == "endif", 1).otherwise(0)
    nested = found.withColumn("depth", depth)
    after = Window.partitionBy("path", "depth").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    closed = nested.withColumn("end_line", F.min(F.when(F.col("word") == "endif", F.col("line"))).over(after)).where("word in ('ifdef', 'ifndef') and end_line is not null")
    return closed.select(F.col("path").alias("file_path"), F.col("rest").alias("condition_text"), F.col("line").alias("start_line"), "end_line", (F.col("word") == "ifndef").alias("is_negated"))


def conditional_symbols(files: DataFrame) -> DataFrame:
    """conditional_symbols: lines inside a block that look like definitions; a range join within each file."""
    pattern = r"^\s*(?:[\w:<>*&,\s]+?\s)?(?:class|struct|enum)?\s*([A-Za-z_]\w*)\s*(?:\([^;]*\)\s*(?:const\s*)?)?\{"
    shaped = lines(files).where(F.col("text").rlike(pattern) & ~F.col("text").rlike(r"^\s*(if|for|while|switch|else|do|namespace|#)")).select(F.col("path").alias("file_path"), "line", F.regexp_extract("text", pattern, 1).alias("symbol_name"))
    return shaped.join(blocks(files), "file_path").where("line > start_line and line < end_line and symbol_name != ''").select("file_path", "symbol_name", "line", F.col("condition_text").alias("gating_macro"), "is_negated")


def risks(files: DataFrame) -> DataFrame:
    """(path, parse_fragility, macro_sensitivity, include_heaviness) by counts of directives."""
    text = F.regexp_replace("text", r"^\s+", "")
    directive = F.regexp_replace(F.regexp_replace(text, "^#", ""), r"^\s+", "")
    is_one = text.startswith("#")
    count = lambda c: F.count(F.when(is_one & c, 1))
    counted = lines(files).groupBy("path").agg(
        F.count(F.when(is_one, 1)).alias("m"), count(directive.startswith("include")).alias("i"), count(directive.startswith("if") | directive.startswith("elif")).alias("c"), count(directive.startswith("define") & directive.contains("(")).alias("f")
    )
    sensitive = (F.col("m") >= 12) | (F.col("c") >= 4) | (F.col("f") >= 3)
    return counted.select("path", F.when(sensitive | (F.col("i") >= 25), "elevated").otherwise("low").alias("parse_fragility"), F.when(sensitive, "high").otherwise("low").alias("macro_sensitivity"), F.when(F.col("i") >= 15, "heavy").otherwise("light").alias("include_heaviness"))


def enclosing(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """sites (path, line, ...) with symbol_id: the smallest symbol around each line, the first by id of equals."""
    spans = symbols.select(F.col("file_path").alias("path"), F.col("id").alias("symbol_id"), F.col("line").alias("from_line"), "end_line")
    keys = sites.columns
    best = sites.join(spans, "path").where("line between from_line and end_line").groupBy(*keys).agg(F.min_by("symbol_id", F.struct(F.col("end_line") - F.col("from_line"), F.col("symbol_id"))).alias("symbol_id"))
    return sites.join(best, keys, "left")


def propagation_kind(source_is_field: Column, target_is_field: Column, default: Column) -> Column:
    """fieldWrite into a field, else fieldRead out of one, else the default."""
    return F.when(target_is_field, "fieldWrite").when(source_is_field, "fieldRead").otherwise(default)


# ---- scanners


@dataclass
class Sighting:
    kind: str  # symbol, call or reference
    name: str
    owner: str | None
    line: int
    end_line: int
    detail: str = ""
    more: dict = field(default_factory=dict)


def module_id(path: str, language: str) -> str:
    """python::a::b, without the file names that stand for their folder."""
    parts = re.sub(r"\.[^./]+$", "", path).split("/")
    drop = {"python": {"__init__"}, "typescript": {"index"}, "rust": {"mod", "lib", "main"}, "lua": {"init"}}[language]
    return "::".join([language, *(parts[:-1] if len(parts) > 1 and parts[-1] in drop else parts)])


_QUOTED = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`", re.DOTALL)
_COMMENTS = {"python": r"#[^\n]*", "lua": r"--[^\n]*"}


def blank(text: str, language: str) -> str:
    """The text with comments and what strings hold as spaces, quotes and lines kept."""
    comment = _COMMENTS.get(language, r"//[^\n]*|/\*.*?\*/")
    quoted = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'' if language != "rust" else r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])\''
    triple = r'"""(?:.|\n)*?"""|\'\'\'(?:.|\n)*?\'\'\'|' if language == "python" else ""
    hidden = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(f"{triple}{comment}|{quoted}", lambda m: m[0][0] + hidden(m)[1:-1] + m[0][-1] if m[0][0] in "\"'" else hidden(m), text, flags=re.DOTALL)


def count_arguments(text: str) -> int:
    """Arguments between parentheses: commas outside inner brackets, plus one; none if blank."""
    depth, n = 0, 1
    for c in text:
        depth += (c in "([{<") - (c in ")]}>")
        n += c == "," and depth == 0
    return n if text.strip() else 0


_WORDS = {"if", "for", "while", "switch", "return", "sizeof", "catch", "elif", "and", "or", "not", "in", "is", "lambda", "def", "class", "function", "match", "fn", "assert", "with", "except", "print", "super", "new", "delete", "throw", "await", "yield", "typeof", "decltype", "alignof", "static_assert"}
_CALL = re.compile(r"(?:(?P<receiver>[\w\]\)]+(?:(?:\.|->)\w+)*)\s*(?P<op>\.|->|::|:)\s*)?(?P<name>[A-Za-z_]\w*)\s*(?:<[\w\s,:*&]*>)?\(")


def calls_of(text: str, first_line: int, owner: str, skip: set[int]) -> Iterator[Sighting]:
    """The calls in a text that begins at first_line; skip holds offsets of definitions' own names."""
    for m in _CALL.finditer(text):
        if m["name"] in _WORDS or m.start("name") in skip:
            continue
        depth, at = 1, m.end()
        while at < len(text) and depth:
            depth += (text[at] == "(") - (text[at] == ")")
            at += 1
        line = first_line + text.count("\n", 0, m.start("name"))
        receiver, op = m["receiver"], m["op"]
        if op == "::":
            kind = "qualified"
        elif receiver in ("this", "self") and op:
            kind = "thisPointerAccess"
        else:
            kind = {None: "unqualified", "->": "pointerMemberAccess"}.get(op, "memberAccess")
        yield Sighting("call", m["name"], owner, line, line, kind, {"receiver": None if op == "::" else receiver, "qualifier": receiver if op == "::" else None, "argument_count": count_arguments(text[m.end() : at - 1])})


def scan_indented(path: str, text: str) -> list[Sighting]:
    """Python: classes, functions and calls by indentation, imports and bases as references."""
    module = module_id(path, "python")
    rows = text.split("\n")
    out = [Sighting("symbol", module.split("::")[-1], None, 1, len(rows), "namespace", {"id": module})]
    plain = blank(text, "python").split("\n")
    stack: list[tuple[int, Sighting]] = [(-1, out[0])]
    for n, row in enumerate(plain, 1):
        if not row.strip():
            continue
        indent = len(row) - len(row.lstrip())
        while stack[-1][0] >= indent:
            stack.pop()
        for _, open_symbol in stack:
            open_symbol.end_line = max(open_symbol.end_line, n)
        owner = stack[-1][1]
        if m := re.match(r"\s*(?:async\s+)?(def|class)\s+(\w+)\s*(\([^)]*\))?", row):
            is_class = m[1] == "class"
            kind = "class" if is_class else "method" if owner.detail == "class" else "function"
            made = Sighting("symbol", m[2], owner.more["id"], n, n, kind, {"id": f"{owner.more['id']}::{m[2]}", "parameter_count": None if is_class else count_arguments((m[3] or "()")[1:-1])})
            out.append(made)
            for base in re.findall(r"[\w.]+", m[3] or "") if is_class else ():
                out.append(Sighting("reference", base.split(".")[-1], made.more["id"], n, n, "inheritanceMention"))
            stack.append((indent, made))
            continue
        if m := re.match(r"\s*(?:from\s+([\w.]+)\s+)?import\s+(.+)", row):
            for part in m[2].strip("() ").split(","):
                name = part.split(" as ")[0].strip()
                if name:
                    out.append(Sighting("reference", "::".join(["python", *(m[1] or name).split(".")]), module, n, n, "moduleImport"))
            continue
        if owner.detail in ("function", "method"):
            out += calls_of(row, n, owner.more["id"], set())
    return out


_OPEN = {
    "cpp": [("namespace", r"\bnamespace\s+([\w:]+)\s*$"), ("enum", r"\benum\s+(?:class\s+|struct\s+)?(\w+)[^{;()]*$"), ("class", r"\b(?:class|struct)\s+(?:\[\[[^\]]*\]\]\s*)?(\w+)(?:\s+final)?\s*(?::([^{;]*))?$"), ("function", r"(?:^|[\s*&>])(~?[A-Za-z_][\w:]*(?:operator[^\s\w(]+)?)\s*\(([^{};]*)\)\s*(?:const|noexcept|override|final|\s|->[\w:<>&*\s]+|:[^;{}]*)*$")],
    "typescript": [("namespace", r"\bnamespace\s+([\w.]+)\s*$"), ("class", r"\b(?:class|interface)\s+(\w+)(?:<[^>]*>)?\s*(?:extends\s+([\w.,\s]+?))?(?:\s*implements[^{]*)?\s*$"), ("enum", r"\benum\s+(\w+)\s*$"), ("function", r"\bfunction\s*\*?\s*(\w+)\s*(?:<[^>]*>)?\(([^{};]*)\)[^{};=]*$"), ("function", r"(?:^|\s)(?:async\s+|static\s+|private\s+|public\s+|protected\s+)*(\w+)\s*\(([^{};]*)\)\s*(?::[^{};=]+)?$")],
    "rust": [("namespace", r"\bmod\s+(\w+)\s*$"), ("impl", r"\bimpl(?:<[^>]*>)?\s+(?:([\w:]+)(?:<[^>]*>)?\s+for\s+)?([\w:]+)[^{;]*$"), ("class", r"\b(?:struct|trait)\s+(\w+)[^{;]*$"), ("enum", r"\benum\s+(\w+)[^{;]*$"), ("function", r"\bfn\s+(\w+)\s*(?:<[^>]*>)?\(([^{};]*)\)[^{};]*$")],
}


def scan_braced(path: str, text: str, language: str) -> list[Sighting]:
    """C++, TypeScript and Rust: what stands before a brace opens a scope; calls belong to the innermost function."""
    plain = blank(text, language)
    if language == "cpp":
        plain = re.sub(r"^[ \t]*#.*$|\b(?:public|private|protected)\s*:(?!:)", lambda m: re.sub(r"[^\n]", " ", m[0]), plain, flags=re.MULTILINE)
        out: list[Sighting] = []
        base: Sighting | None = None
    else:
        module = module_id(path, language)
        base = Sighting("symbol", module.split("::")[-1], None, 1, text.count("\n") + 1, "namespace", {"id": module})
        out = [base]
    line_at = lambda k: plain.count("\n", 0, k) + 1
    stack: list[tuple[Sighting | None, int]] = []
    last = 0

    def owner() -> Sighting | None:
        return next((s for s, _ in reversed(stack) if s is not None), base)

    for at, c in enumerate(plain):
        if c in ";}" and c != "{":
            if c == "}" and stack:
                made, start = stack.pop()
                if made is not None and made.kind == "symbol":
                    made.end_line = line_at(at)
                    if made.detail in ("function", "method"):
                        inner = plain[start:at]
                        out += calls_of(inner, line_at(start), made.more["id"], set())
            if c == ";" and language == "cpp":
                head = plain[last:at].strip()
                around = owner()
                m = re.search(r"(?:^|[\s*&])(~?[A-Za-z_]\w*)\s*\(([^{};]*)\)\s*(?:const|noexcept|override|final|\s|=\s*(?:0|default|delete))*$", head)
                if m and around is not None and around.detail in ("class", "namespace") and "=" not in head.split("(")[0] and m[1] not in _WORDS:
                    virtual = "virtual" in head.split("(")[0] or head.rstrip().endswith(("override", "= 0"))
                    out.append(Sighting("symbol", m[1], around.more["id"], line_at(last + len(plain[last:at]) - len(plain[last:at].lstrip())), line_at(at), "method" if around.detail == "class" else "function", {"id": f"{around.more['id']}::{m[1]}", "parameter_count": count_arguments(m[2]), "role": "pure_virtual" if re.search(r"=\s*0$", head) else "virtual" if virtual else "declaration"}))
            last = at + 1
            continue
        if c != "{":
            continue
        head = plain[last:at].strip()
        around, made = owner(), None
        in_function = around is not None and around.detail in ("function", "method")
        for kind, pattern in _OPEN[language] if not in_function else ():
            m = re.search(pattern, head)
            if not m:
                continue
            if kind == "impl":
                prefix = around.more["id"] if around else ""
                made = Sighting("scope", m[2], prefix, line_at(at), line_at(at), "class", {"id": f"{prefix}::{m[2]}"})
                if m[1]:
                    out.append(Sighting("reference", m[1], made.more["id"], line_at(at), line_at(at), "inheritanceMention"))
                break
            name = m[1]
            if name in _WORDS:
                continue
            prefix = around.more["id"] + "::" if around else ""
            real = kind
            if kind == "function" and ((around is not None and around.detail == "class") or (language == "cpp" and "::" in name)):
                real = "method"
            more = {"id": prefix + name, "role": "definition"}
            if kind == "function":
                more["parameter_count"] = count_arguments(m[2])
            start = last + len(plain[last:at]) - len(plain[last:at].lstrip())
            made = Sighting("symbol", name.split("::")[-1], around.more["id"] if around else None, line_at(start), line_at(at), real, more)
            out.append(made)
            if kind == "class" and m.lastindex and m.lastindex > 1 and m[2]:
                for b in m[2].split(","):
                    if word := re.sub(r"\b(public|private|protected|virtual)\b|<.*", "", b).strip():
                        out.append(Sighting("reference", re.split(r"::|\.", word)[-1], made.more["id"], made.line, made.line, "inheritanceMention"))
            break
        stack.append((made, at + 1))
        last = at + 1
    return out


def scan_lua(path: str, text: str) -> list[Sighting]:
    """Lua: functions up to their end by block words, requires as references."""
    module = module_id(path, "lua")
    rows = blank(text, "lua").split("\n")
    out = [Sighting("symbol", module.split("::")[-1], None, 1, len(rows), "namespace", {"id": module})]
    stack: list[Sighting | None] = []
    for n, (row, raw) in enumerate(zip(rows, text.split("\n"), strict=True), 1):
        for name in re.findall(r"""\brequire\s*\(?\s*["']([\w./]+)["']""", raw):
            out.append(Sighting("reference", "::".join(["lua", *re.split(r"[./]", name)]), module, n, n, "moduleImport"))
        m = re.search(r"\bfunction\s+([\w.:]+)\s*\(([^)]*)\)|\b(?:local\s+)?([\w.]+)\s*=\s*function\s*\(([^)]*)\)", row)
        current = next((s for s in reversed(stack) if s is not None), None)
        opened = len(re.findall(r"\b(?:function|if|for|while)\b", row)) + len(re.findall(r"\brepeat\b", row))
        if re.search(r"\bdo\b", row) and not re.search(r"\b(?:for|while)\b", row):
            opened += 1
        closed = len(re.findall(r"\b(?:end|until)\b", row))
        if m:
            name = m[1] or m[3]
            parts = re.split(r"[.:]", name)
            made = Sighting("symbol", parts[-1], "::".join([module, *parts[:-1]]), n, n, "method" if ":" in name else "function", {"id": "::".join([module, *parts]), "parameter_count": count_arguments(m[2] if m[1] else m[4])})
            out.append(made)
            stack.append(made)
            opened -= 1
        elif current is not None and "require" not in row:
            out += calls_of(row, n, current.more["id"], set())
        stack += [None] * opened
        for _ in range(min(closed, len(stack))):
            ended = stack.pop()
            if ended is not None:
                ended.end_line = n
    return out


def scan(path: str, text: str, language: str) -> list[Sighting]:
    if language == "python":
        return scan_indented(path, text)
    return scan_lua(path, text) if language == "lua" else scan_braced(path, text, language)


_ROWS = "kind string, id string, name string, owner string, detail string, role string, parameter_count int, receiver string, qualifier string, argument_count int, file_path string, line int, end_line int"


def sightings(files: DataFrame) -> DataFrame:
    """Symbols, calls and references of files (path, text, language), one row each: what kind says.

    One file is scanned in one task; files are dealt by the rows' partitions.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _ROWS.split(", ")]
        for batch in batches:
            rows = []
            for path, text, language in zip(batch["path"], batch["text"], batch["language"], strict=True):
                for s in scan(path, text or "", language):
                    if s.kind != "scope":
                        rows.append((s.kind, s.more.get("id"), s.name, s.owner, s.detail, s.more.get("role"), s.more.get("parameter_count"), s.more.get("receiver"), s.more.get("qualifier"), s.more.get("argument_count"), path, s.line, s.end_line))
            yield pd.DataFrame(rows, columns=columns).astype({"parameter_count": "Int32", "argument_count": "Int32"})

    return files.select("path", "text", "language").mapInPandas(run, _ROWS)


def graph_rows(found: DataFrame) -> dict[str, DataFrame]:
    """Sightings as raw symbols, raw calls and relation events, the tables that merging and resolution start from."""
    symbols = found.where("kind = 'symbol'").select("id", "name", F.regexp_replace("id", "^::", "").alias("qualified_name"), F.col("detail").alias("type"), "file_path", "line", "end_line", "parameter_count", F.col("role").alias("symbol_role"), F.col("owner").alias("parent_id"))
    calls = found.where("kind = 'call'").select(F.col("owner").alias("caller_id"), F.col("name").alias("called_name"), F.col("detail").alias("call_kind"), "argument_count", "receiver", "qualifier", F.when(F.col("qualifier").isNotNull(), "namespace").alias("qualifier_kind"), F.lit(None).cast("string").alias("pre_resolved_callee_id"), "file_path", "line")
    events = found.where("kind = 'reference'").select(F.col("owner").alias("source_id"), F.col("name").alias("target_name"), F.col("detail").alias("category"), F.lit(None).cast("string").alias("namespace_hint"), "file_path", "line")
    return {"symbols_raw": symbols, "raw_calls": calls, "relation_events": events}

"""Schemas of the code-graph tables. Optional text is null, never empty."""

from __future__ import annotations

from pyspark.sql import types as T

_SYMBOL = (
    "id string, name string, qualified_name string, type string, file_path string, line int, end_line int, signature string, parameter_count int, "
    "scope_qualified_name string, scope_kind string, symbol_role string, declaration_file_path string, declaration_line int, declaration_end_line int, "
    "definition_file_path string, definition_line int, definition_end_line int, parent_id string, module string, subsystem string, project_area string, "
    "artifact_kind string, header_role string, parse_fragility string, macro_sensitivity string, include_heaviness string"
)
_ANCHOR = "struct<anchor_id:string,symbol_id:string,expression_text:string,anchor_kind:string>"

#: Table name -> DDL.
TABLES: dict[str, str] = {
    "symbols_raw": _SYMBOL,
    "symbols": _SYMBOL,
    "calls": "caller_id string, callee_id string, file_path string, line int, resolution_tier string",
    "raw_calls": f"caller_id string, called_name string, call_kind string, argument_count int, argument_texts array<string>, result_target {_ANCHOR}, receiver string, receiver_kind string, qualifier string, qualifier_kind string, pre_resolved_callee_id string, file_path string, line int",
    "symbol_references": "source_symbol_id string, target_symbol_id string, category string, file_path string, line int, confidence string",
    "propagation_events": "owner_symbol_id string, source_anchor_id string, source_symbol_id string, source_expression_text string, source_anchor_kind string, target_anchor_id string, target_symbol_id string, target_expression_text string, target_anchor_kind string, propagation_kind string, file_path string, line int, confidence string, risks array<string>",
    "callable_flow_summaries": f"callable_symbol_id string, file_path string, parameter_anchors array<{_ANCHOR}>, return_anchors array<{_ANCHOR}>",
    "files": "path string, content_hash string, last_indexed string, symbol_count int, module string, subsystem string, project_area string, artifact_kind string, header_role string, parse_fragility string, macro_sensitivity string, include_heaviness string",
    "include_dependencies": "source_file string, included_file string, line int, is_system_include boolean",
    "macro_definitions": "file_path string, name string, value string, line int, macro_type string",
    "conditional_blocks": "file_path string, condition_text string, start_line int, end_line int, is_negated boolean",
    "conditional_symbols": "file_path string, symbol_name string, line int, gating_macro string, is_negated boolean",
    "circular_dependencies": "cycle array<string>",
    "db_metadata": "key string, value string",
}

SYMBOL_COLUMNS = [c.split()[0] for c in _SYMBOL.split(", ")]


def struct(name: str) -> T.StructType:
    """The Spark schema of a table."""
    return T.StructType.fromDDL(TABLES[name])

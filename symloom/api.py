"""The engine's tools by name: each takes one symbol's parameters and answers with DataFrames.

Behind every tool stands the operator for sets of seeds; ask those directly to answer for many symbols in one job.
Parameters that fit no symbol raise NotFound, contradicting or missing ones BadRequest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.functions import strings as S
from symloom.operators import edges, flow, investigate, lookup, traverse

#: Limits of pages, depths and nodes.
LIMIT, MAX_LIMIT, DEPTH, MAX_DEPTH, NODES, MAX_NODES = 50, 200, 3, 10, 200, 1000


class BadRequest(ValueError):
    pass


class NotFound(LookupError):
    pass


class Engine:
    """graph has the tables as attributes: symbols, symbols_raw, calls, raw_calls, symbol_references, propagation_events, files."""

    def __init__(self, graph) -> None:
        self.graph = graph

    def _seed(self, symbol_id: str, column: str = "id") -> DataFrame:
        return self.graph.symbols.sparkSession.createDataFrame([(symbol_id,)], f"{column} string")

    def _exact(self, symbol_id: str | None, qualified_name: str | None) -> str:
        if not symbol_id and not qualified_name:
            raise BadRequest("an id or a qualified name is needed")
        named = self.graph.symbols.where(F.col("qualified_name") == qualified_name) if qualified_name else self.graph.symbols.where(F.col("id") == symbol_id)
        found = lookup.by_qualified_name(named).select("id").head(1)
        if not found:
            raise NotFound(symbol_id or qualified_name)
        if symbol_id and qualified_name and found[0]["id"] != symbol_id:
            raise BadRequest("id and qualified name are of different symbols")
        return found[0]["id"]

    def _ranked(self, name: str, types: list[str], context: dict) -> DataFrame:
        ranked = lookup.ranked(self.graph.symbols.where(F.col("name") == name), types, **context)
        if not ranked.head(1):
            raise NotFound(name)
        return ranked

    def _best(self, name: str, types: list[str], context: dict) -> str:
        return self._ranked(name, types, context).where("rank = 1").first()["id"]

    @staticmethod
    def _limit(limit: int, most: int = MAX_LIMIT) -> int:
        return max(1, min(limit, most))

    def _edges(self, up: bool = False, confirmed_only: bool = False) -> DataFrame:
        a, b = ("callee_id", "caller_id") if up else ("caller_id", "callee_id")
        return edges.edges_of(self.graph.calls, confirmed_only).select(F.col(a).alias("src"), F.col(b).alias("dst"), F.col("line").alias("ord"))

    def lookup_symbol(self, symbol_id: str | None = None, qualified_name: str | None = None) -> dict[str, DataFrame]:
        found, g = self._exact(symbol_id, qualified_name), self.graph
        return {"symbol": g.symbols.where(F.col("id") == found), "callers": edges.call_refs(g.calls.where(F.col("callee_id") == found), g.symbols), "callees": edges.call_refs(g.calls.where(F.col("caller_id") == found), g.symbols, "callee_id"), "members": g.symbols.where(F.col("parent_id") == found)}

    def lookup_function(self, name: str, **context) -> dict[str, DataFrame]:
        ranked = self._ranked(name, lookup.CALLABLE, context)
        return {"candidates": ranked, **self.lookup_symbol(ranked.where("rank = 1").first()["id"])}

    def lookup_class(self, name: str, **context) -> dict[str, DataFrame]:
        ranked = self._ranked(name, ["class", "struct"], context)
        return {"candidates": ranked, "members": self.graph.symbols.join(ranked.where("rank = 1").select(F.col("id").alias("parent_id")), "parent_id", "left_semi")}

    def find_callers(self, name: str, limit: int = LIMIT, offset: int = 0, confirmed_only: bool = False, filters: dict | None = None, **context) -> dict[str, DataFrame]:
        g, seed = self.graph, self._seed(self._best(name, lookup.CALLABLE, context))
        found = edges.unique_callers(g.calls, g.symbols, seed, self._limit(limit), offset, confirmed_only, **(filters or {}))
        recovered = edges.recovered_callers(g.raw_calls, g.symbols, g.symbol_references, g.calls).join(seed.withColumnRenamed("id", "callee_id"), "callee_id", "left_semi")
        return {"callers": found, "recovered": recovered, "groups": edges.caller_groups(g.calls.join(seed.withColumnRenamed("id", "callee_id"), "callee_id", "left_semi"), g.symbols)}

    def find_all_overloads(self, name: str) -> DataFrame:
        return lookup.overloads(self.graph.symbols.where(F.col("name") == name))

    def find_references(self, symbol_id: str | None = None, qualified_name: str | None = None, category: str | None = None, file_path: str | None = None, limit: int = LIMIT, offset: int = 0, include_enum_members: bool = False) -> DataFrame:
        found, g = self._exact(symbol_id, qualified_name), self.graph
        targets = g.symbols.where((F.col("id") == found) | (F.lit(include_enum_members) & (F.col("parent_id") == found) & (F.col("type") == "enumMember")))
        stored = edges.references(g.symbol_references.join(targets.select(F.col("id").alias("target_symbol_id")), "target_symbol_id", "left_semi"), category, file_path)
        access = edges.member_access(g.raw_calls, targets) if category in (None, "memberAccess") else g.symbol_references.where("false")
        return edges.reference_query(stored, access, g.symbols, self._limit(limit), offset)

    def explain_symbol_propagation(self, symbol_id: str | None = None, qualified_name: str | None = None) -> DataFrame:
        return flow.explain(flow.at_symbols(self.graph.propagation_events, self._seed(self._exact(symbol_id, qualified_name))))

    def trace_variable_flow(self, symbol_id: str | None = None, qualified_name: str | None = None, max_depth: int = DEPTH, max_edges: int = 50) -> DataFrame:
        return flow.trace(self.graph.propagation_events, self._seed(self._exact(symbol_id, qualified_name)), max_depth, max_edges)

    def impact_analysis(self, symbol_id: str | None = None, qualified_name: str | None = None, depth: int = 2, limit: int = LIMIT) -> DataFrame:
        g, seed = self.graph, self._seed(self._exact(symbol_id, qualified_name), "seed")
        return traverse.impact(g.calls, g.symbol_references, g.symbols, seed, min(depth, MAX_DEPTH), self._limit(limit))

    def list_file_symbols(self, file_path: str, limit: int = MAX_LIMIT) -> DataFrame:
        return lookup.overview(self.graph.symbols.where(F.col("file_path") == file_path), "file_path", self._limit(limit))

    def list_namespace_symbols(self, qualified_name: str, limit: int = MAX_LIMIT) -> DataFrame:
        spaces = self.graph.symbols.where((F.col("qualified_name") == qualified_name) & (F.col("type") == "namespace"))
        if not spaces.head(1):
            raise NotFound(qualified_name)
        return lookup.overview(self.graph.symbols.where(F.col("scope_qualified_name") == qualified_name), "scope_qualified_name", self._limit(limit))

    def list_class_members(self, symbol_id: str | None = None, qualified_name: str | None = None, limit: int = MAX_LIMIT) -> DataFrame:
        return lookup.overview(self.graph.symbols.where(F.col("parent_id") == self._exact(symbol_id, qualified_name)), "parent_id", self._limit(limit))

    def get_type_hierarchy(self, symbol_id: str | None = None, qualified_name: str | None = None, limit: int = LIMIT) -> DataFrame:
        return lookup.type_hierarchy(self.graph.symbols, self.graph.symbol_references, self._limit(limit)).where(F.col("id") == self._exact(symbol_id, qualified_name))

    def find_base_methods(self, symbol_id: str | None = None, qualified_name: str | None = None) -> DataFrame:
        return lookup.override_candidates(self.graph.symbols, self.graph.symbol_references).where(F.col("derived_id") == self._exact(symbol_id, qualified_name))

    def find_overrides(self, symbol_id: str | None = None, qualified_name: str | None = None) -> DataFrame:
        return lookup.override_candidates(self.graph.symbols, self.graph.symbol_references).where(F.col("base_id") == self._exact(symbol_id, qualified_name))

    def trace_call_path(self, source: str, target: str, max_depth: int = DEPTH, confirmed_only: bool = False) -> DataFrame:
        pair = self.graph.symbols.sparkSession.createDataFrame([(self._exact(None, source), self._exact(None, target))], "seed string, goal string")
        return traverse.shortest_paths(self._edges(confirmed_only=confirmed_only), pair, min(max_depth, MAX_DEPTH))

    def investigate_workflow(self, source: str, target: str | None = None, max_depth: int = DEPTH, max_edges: int = 50) -> dict[str, DataFrame]:
        pair = self.graph.symbols.sparkSession.createDataFrame([(self._exact(None, source), self._exact(None, target) if target else None)], "source string, target string")
        return investigate.investigate(self.graph.calls, self.graph.propagation_events, self.graph.symbols, pair, min(max_depth, MAX_DEPTH), max_edges)

    def search_symbols(self, query: str, types: list[str] | None = None, limit: int = LIMIT, offset: int = 0, **filters) -> DataFrame:
        return lookup.search(self.graph.symbols, query, types, self._limit(limit), offset, **filters)

    def workspace_summary(self) -> DataFrame:
        return lookup.workspace_summary(self.graph.files)

    def get_callgraph(self, name: str, depth: int = DEPTH, direction: str = "callees", node_cap: int = NODES, **context) -> DataFrame:
        seed = self._seed(self._best(name, lookup.CALLABLE, context), "seed")
        depth, node_cap = min(depth, MAX_DEPTH), self._limit(node_cap, MAX_NODES)
        if direction not in ("callees", "callers", "both"):
            raise BadRequest(direction)
        down = traverse.call_tree(self._edges(), seed, depth, node_cap).withColumn("direction", F.lit("callees"))
        up = traverse.call_tree(self._edges(up=True), seed, depth, node_cap).withColumn("direction", F.lit("callers"))
        if direction != "both":
            return down if direction == "callees" else up
        # callers take what callees leave of the nodes
        spent = down.groupBy("seed").agg(F.count(F.lit(1)).alias("spent"))
        return down.unionByName(up.join(spent, "seed", "left").where(F.col("position") < node_cap - F.coalesce("spent", F.lit(0))).drop("spent"))

    def find_callers_recursive(self, name: str, depth: int = DEPTH, node_cap: int = NODES, confirmed_only: bool = False, **context) -> DataFrame:
        seed = self._seed(self._best(name, lookup.CALLABLE, context), "seed")
        return traverse.call_tree(self._edges(up=True, confirmed_only=confirmed_only), seed, min(depth, MAX_DEPTH), self._limit(node_cap, MAX_NODES))

    def anchor_context(self, symbol_id: str) -> dict[str, DataFrame]:
        """What ranking can know of an anchor: its neighbours in the call graph, and the scopes around it."""
        g = self.graph
        neighbors = g.calls.where(F.col("callee_id") == symbol_id).select(F.col("caller_id").alias("id")).union(g.calls.where(F.col("caller_id") == symbol_id).select("callee_id")).distinct()
        return {"neighbors": neighbors, "scopes": g.symbols.where(F.col("id") == symbol_id).select(F.explode(S.scope_prefixes(F.col("qualified_name"))).alias("scope"))}

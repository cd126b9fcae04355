"""All queries of the estate engine and their DuckDB oracles."""

from __future__ import annotations

from lodestrata.plans import graph_queries, pack_queries, report_queries, source_queries, stream_queries, text_queries, tree_queries

MODULES = (graph_queries, text_queries, source_queries, report_queries, tree_queries, stream_queries, pack_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}

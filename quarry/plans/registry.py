"""All core queries and their SQL."""

from __future__ import annotations

from quarry.plans import gold_queries, graph_queries, hierarchy_queries, mining_queries, program_queries, source_queries, spec_queries, stream_queries, vector_queries

_MODULES = [hierarchy_queries, mining_queries, graph_queries, gold_queries, spec_queries, vector_queries, source_queries, program_queries, stream_queries]

FLAGSHIP = "basket_pairs_flagship"
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}

"""All registered queries of the library with their DuckDB SQL, gathered from the families."""

from __future__ import annotations

from . import finding_queries, graph_queries, ledger_queries, metric_queries, run_queries, scan_queries, stream_queries, structure_queries

FAMILIES = (ledger_queries, run_queries, metric_queries, finding_queries, graph_queries, scan_queries, stream_queries, structure_queries)
QUERIES = {name: run for family in FAMILIES for name, run in family.REGISTRY.queries.items()}
ORACLES = {name: sql for family in FAMILIES for name, sql in family.REGISTRY.oracles.items()}

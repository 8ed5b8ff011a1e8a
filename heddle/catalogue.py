"""Every query of the library by name, and its DuckDB SQL."""

from __future__ import annotations

from heddle.plans import graph_queries, index_queries, ledger_queries, search_queries, source_queries, store_queries, text_queries
from heddle.plans.registry import Query

MODULES = (text_queries, graph_queries, ledger_queries, search_queries, store_queries, source_queries, index_queries)


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.R.sql.items()}

"""All queries of this subpackage."""

from flowloom.llm import document_queries, flow_queries

_MODULES = [flow_queries, document_queries]


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.oracle_sql().items()}

"""Every operator as a query over the driver's tables, with DuckDB SQL that gives the same rows."""

from graphloom.catalog import evaluation, graph, ingestion, lookup, operations, retrieval

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (lookup, retrieval, graph, ingestion, operations, evaluation):
    QUERIES |= _module.registry.queries
    ORACLES |= _module.registry.oracles

"""Registries: QUERIES maps a name to (spark, sf_dir) -> DataFrame, ORACLE_SQL to the same result in DuckDB SQL."""

from __future__ import annotations

from foliospark.plans import agents, builds, chunks, graphs, records, retrieval, structures, texts, vectorial

_MODULES = (retrieval, texts, structures, chunks, vectorial, graphs, agents, records, builds)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}

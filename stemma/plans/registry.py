"""All queries of the engine by name, with the SQL that states the same."""

from __future__ import annotations

from stemma.plans import embeddings, jobs, lexical, library, relations, sources

FLAGSHIP = "bm25_search"
_PARTS = (lexical, embeddings, relations, sources, library, jobs)
QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}

"""The operators applied to the test tables, each with DuckDB SQL for the same rows where SQL can."""

from __future__ import annotations

from parlance.queries import artifacts, chat, dataset, evaluation, ingest, panel, store, tokens
from parlance.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "artifacts", "chat", "dataset", "evaluation", "ingest", "panel", "store", "tokens"]

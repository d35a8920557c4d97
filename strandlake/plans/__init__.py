"""Queries over the project's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from strandlake.plans import alignment_queries, interval_queries, more_queries, problems, signal_queries, source_queries, species_queries, stream_queries, table_queries

_MODULES = (problems, interval_queries, alignment_queries, signal_queries, table_queries, more_queries, stream_queries, species_queries, source_queries)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def sql() -> dict:
    return {k: q for m in _MODULES for k, q in m.SQL.items()}

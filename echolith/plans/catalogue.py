"""All registered queries with the SQL that DuckDB runs for them."""

from __future__ import annotations

from . import application, decisions, discovery, learned, libraries, rows, scores, signals

QUERIES: dict = {**decisions.QUERIES, **signals.QUERIES, **discovery.QUERIES, **learned.QUERIES, **scores.QUERIES, **application.QUERIES, **rows.QUERIES, **libraries.QUERIES}
ORACLE_SQL: dict = {**decisions.SQL, **signals.SQL, **discovery.SQL, **learned.SQL, **scores.SQL, **application.SQL, **rows.SQL, **libraries.SQL}

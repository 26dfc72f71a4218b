"""Every query of the engine by name, with SQL for the same rows."""

from __future__ import annotations

from . import knowledge, retrieval

QUERIES = {**retrieval.QUERIES, **knowledge.QUERIES}
ORACLE_SQL = {**retrieval.ORACLE_SQL, **knowledge.ORACLE_SQL}

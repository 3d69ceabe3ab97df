"""Registered queries, one module for each family; each module has QUERIES and ORACLE."""

from __future__ import annotations

from postflow.queries import authorisation, feeds, posting, relational, scalars, streams, summaries

MODULES = [authorisation, feeds, relational, summaries, scalars, posting, streams]
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: q for m in MODULES for name, q in m.ORACLE.items()}

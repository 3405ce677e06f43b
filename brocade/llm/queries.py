"""All queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from brocade.llm import queries_numbers, queries_places, queries_text

_PARTS = (queries_numbers, queries_places, queries_text)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
SQL = {k: s for part in _PARTS for k, s in part.SQL.items()}

"""All core queries by name, with their SQL."""

from __future__ import annotations

from spanforge.plans import boxes, curation, duplicates, events, matching, metrics, packed_fields, relations, reports, rules

_PARTS = (packed_fields, duplicates, boxes, matching, metrics, curation, events, reports, rules, relations)

QUERIES = {name: run for part in _PARTS for name, run in part.QUERIES.items()}
SQL = {name: text for part in _PARTS for name, text in part.SQL.items()}

"""The queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from folio.plans import fixtures, knowledge, structure, tables

QUERIES = tables.QUERIES | fixtures.QUERIES | structure.QUERIES | knowledge.QUERIES
ORACLES = tables.ORACLES | fixtures.ORACLES | structure.ORACLES | knowledge.ORACLES

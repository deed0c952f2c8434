"""All queries of the llm subpackage and their oracle SQL."""

from __future__ import annotations

from strandlake.llm import queries_records, queries_texts

_MODULES = (queries_records, queries_texts)

QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}

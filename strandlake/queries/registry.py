"""All registered queries of the core and their oracle SQL."""

from __future__ import annotations

from strandlake.queries import callers, calls, compacts, confidence, contexts, extended, formats, genome, joins, parts, pileups, problems, readchanges, recalibration, reports, somatics, summaries

_MODULES = (problems, genome, pileups, recalibration, calls, somatics, callers, formats, readchanges, joins, contexts, parts, reports, confidence, extended, compacts, summaries)


def queries() -> dict:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}

"""All queries of the library, collected from the plan modules."""

from __future__ import annotations

from quarry.plans import catalog, composites, control, datasets, labels, log, pages, scores, services

FLAGSHIP = "a04_quality_report"
MODULES = [catalog, composites, control, datasets, labels, log, pages, scores, services]


def queries() -> dict:
    return {name: q[0] for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: q[1] for m in MODULES for name, q in m.QUERIES.items() if q[1]}

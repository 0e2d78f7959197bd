"""Every registered query."""

from cliploom.plans import (  # noqa: F401
    checks_base, normalization, selection, answers, decisions, captions, audits, lineage, evaluation,
    documents, identity, streams,
)
from cliploom.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

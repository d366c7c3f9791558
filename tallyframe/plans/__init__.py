"""All queries of the engine, with their SQL."""

from tallyframe.plans import checklists, datasets, details, evaluation, extended, forensics, judges, lint, reports  # noqa: F401
from tallyframe.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

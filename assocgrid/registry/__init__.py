"""Queries over the given tables, each with its SQL counterpart where SQL can state it."""

from assocgrid.registry import cohorts, nested_files, screening, tables, unknowns, workflows  # noqa: F401
from assocgrid.registry.base import REGISTRY

__all__ = ["REGISTRY"]

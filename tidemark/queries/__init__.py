"""Registered queries: each operator on the shared tables, with the SQL that states the same result."""

from . import ensembles, facts, market, modeling, panels, reports, roundtrips, texts, validation  # noqa: F401  (modules register on import)
from .registry import REGISTRY

__all__ = ["REGISTRY"]

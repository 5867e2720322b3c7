"""Registered queries and their oracle SQL, one module per area."""

from foliant.plans import (  # noqa: F401
    identifiers,
    listing,
    paths,
    tree,
    stats,
    pages,
    search,
    resolve,
    imports,
    updates,
    categorise,
    streams,
)
from foliant.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

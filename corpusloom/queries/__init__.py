"""The registered queries and their oracle SQL."""

from corpusloom.queries import (  # noqa: F401
    detect,
    documents,
    headers,
    monorepo,
    profiles,
    rules,
    scan,
    sections,
    selection,
    trees,
)
from corpusloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

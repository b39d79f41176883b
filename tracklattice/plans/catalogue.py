"""All queries of the core operators with their DuckDB counterparts."""

from __future__ import annotations

from tracklattice.plans import classifying, coding, exchanging, further, linking, resolving, sequences, vectorial  # noqa: F401
from tracklattice.plans.registry import ORACLES, QUERIES

FLAGSHIP = "majority_tempo"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

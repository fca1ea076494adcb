"""All queries of the monitoring operators on the synthetic tables: QUERIES by name, SQL where it can express them."""

from __future__ import annotations

from tidemark.plans import core, measures, more, networks, rest, stored, stories  # noqa: F401  (each registers its queries)
from tidemark.plans.registry import QUERIES, SQL

FLAGSHIP = "co08_validated_edges"
__all__ = ["FLAGSHIP", "QUERIES", "SQL"]

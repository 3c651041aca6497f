"""Registered queries. Importing this package fills the registry."""

from touchline.plans import audits, build, cards, derived, lineage, raw, research, streams  # noqa: F401
from touchline.plans.registry import QUERIES, SQL, compose

compose()

__all__ = ["QUERIES", "SQL"]

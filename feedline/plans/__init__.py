"""All registered queries."""

from feedline.plans import feeds, html, incremental, listings, sources, streams, tables  # noqa: F401
from feedline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

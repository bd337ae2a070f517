"""Named queries over the test tables, each next to the SQL that checks it."""

from flightlens.registry import dimensions, facts, incoming, lookups, storage, storms, upkeep, views
from flightlens.registry.query import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "dimensions", "facts", "incoming", "lookups", "storage", "storms", "upkeep", "views"]

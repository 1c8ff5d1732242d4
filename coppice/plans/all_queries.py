"""All queries of the analytics side: importing the modules registers them."""

from . import fixtures, health_fixtures, rule_queries, scoring  # noqa: F401
from .catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

"""All queries of the engine proper: importing the modules registers them."""

from framelark.plans import discoveryqueries, scalarqueries, servicequeries, sourcequeries, tracequeries, viewqueries  # noqa: F401
from framelark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

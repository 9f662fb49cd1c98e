"""All queries over the reference tables, and their SQL."""

from quern.plans import text_queries  # noqa: F401  its queries register themselves
from quern.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""All queries of the library by name, and their SQL."""

from kindred.plans import more_queries  # noqa: F401  (adds its queries to the tables below)
from kindred.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

"""Registered queries: ``QUERIES`` by name, and their SQL in ``ORACLE``."""

from sitewise.plans import cohort_queries as _more  # noqa: F401 (registers its queries)
from sitewise.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

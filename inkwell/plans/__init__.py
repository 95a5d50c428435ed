"""Registered jobs: one per operator key of SURVEY §2, each with its oracle SQL
where the job is SQL-expressible."""

from inkwell.plans import census, enrichment, precincts, schools, spatial, titles, trends  # noqa: F401
from inkwell.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]

"""All queries of the library: importing the modules fills the catalog."""

from starloom.plans import analysis_queries, box_queries, spatial_queries  # noqa: F401
from starloom.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

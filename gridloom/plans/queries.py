"""All queries of the grid engine."""

from gridloom.plans import grid_queries, plant_queries, shape_queries, source_queries, table_queries  # noqa: F401
from gridloom.plans.registry import ORACLES, QUERIES  # noqa: F401

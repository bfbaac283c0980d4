"""Every query of the tile-set engine by name, each with SQL for the same rows where SQL can express it."""

from .plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

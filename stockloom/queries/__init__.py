"""Queries of every operator on the star-schema test tables, each next to its SQL."""

from stockloom.queries import assets, catalog, checks, edges, files, scoped, shops  # noqa: F401
from stockloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Queries over the given tables, each with the SQL it must agree with."""

from . import algebra, catalog, geometry, projections, raster, render, series, storage  # noqa: F401
from . import stacks  # noqa: F401  (after those whose SQL it shares)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

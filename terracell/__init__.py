"""Raster time-series analytics as Spark DataFrames.

A layer is a DataFrame of cells (layer, time_index, col, row, band, value) or, for
storage, of tiles holding dense arrays. Every operator takes and returns lazy
DataFrames, so a chain of them is one Catalyst plan.
"""

__version__ = "0.1.0"

"""Reading rasters and catalogs, writing layers."""

"""graticule: feature learning, raster and graph analytics as Spark DataFrame operations."""

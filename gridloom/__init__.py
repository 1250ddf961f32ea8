"""Raster, point and table analytics on Spark DataFrames."""

"""Readers and writers of rasters, points and records as Spark data sources."""

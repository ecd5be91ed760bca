"""Hazard monitoring on Spark: posts, reports, scenes and raster tiles as DataFrames."""

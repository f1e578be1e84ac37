"""Tessera: tiled raster analytics as PySpark DataFrames."""

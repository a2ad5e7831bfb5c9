"""Gridded, time-series and spatial analytics on PySpark DataFrames."""

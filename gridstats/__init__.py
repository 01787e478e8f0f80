"""Gridded climate-ensemble and crop-impact analytics on Spark DataFrames."""

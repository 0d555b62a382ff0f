"""Layered (Bronze, Silver, Gold) analytics over periodic snapshots, on Spark DataFrames."""

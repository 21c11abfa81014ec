"""Incremental dataset builds on Spark: assets are rows, pipelines are DataFrame jobs."""

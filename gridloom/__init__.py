"""Gridded and point data analytics on Spark."""

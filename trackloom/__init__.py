"""Spatial network analytics on PySpark."""

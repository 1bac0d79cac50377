"""Dialect text analytics on PySpark."""

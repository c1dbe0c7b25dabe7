"""Starloom: point-constellation registration and analytics as PySpark DataFrame plans."""

"""Granary: cataloguing, sampling, measuring and training-data operators on PySpark."""

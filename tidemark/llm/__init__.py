"""Operators for large training-data pipelines.

Nothing outside this package imports it; ``__spark_entry__`` registers its
queries when the package is present.
"""

"""Operators for large-scale training-data pipelines.

Nothing else in the package imports this subpackage; ``__spark_entry__`` adds its queries only if it is there.
"""

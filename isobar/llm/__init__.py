"""Operators for large-scale training-data pipelines. Nothing else in isobar imports this package."""

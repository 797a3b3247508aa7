"""Operators of a large training-data pipeline. Nothing else in the package imports this folder."""

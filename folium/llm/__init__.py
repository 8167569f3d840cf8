"""Operators of a training-data pipeline.

Nothing outside this package imports it: the rest of the library works without it.
"""

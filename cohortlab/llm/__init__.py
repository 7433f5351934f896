"""Operators of a training-data pipeline: one module each; queries and SQL are in ``queries``."""

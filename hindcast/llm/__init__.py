"""Operators of a training-data pipeline: one module per operator, ``catalog`` registers their queries."""

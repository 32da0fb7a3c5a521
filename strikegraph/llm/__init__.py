"""Operators for large-scale training-data pipelines, one module per operator.

Nothing outside this subpackage imports it; ``queries.py`` registers the thin queries.
"""

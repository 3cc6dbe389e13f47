"""Operators for large training-text pipelines.

Each module holds one operator with a general interface; ``queries`` wraps them
into the thin ``opN_<name>`` queries. Nothing outside this folder imports it.
"""

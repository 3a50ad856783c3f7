"""Corpus operators for training-data pipelines.

Nothing outside this package imports it.  ``registry.QUERIES`` and
``registry.ORACLES`` hold the registered queries.
"""

"""Operators for large training-text pipelines and their queries.

Nothing else in the library imports this package. ``QUERIES`` and ``ORACLES``
(filled by ``tonelake.llm.queries``) hold the named queries.
"""

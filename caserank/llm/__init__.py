"""Operators of a training-data pipeline: packing, language-model scoring, quality
rules and classification, chat formatting, URL filtering, exact vector search, BPE,
near-duplicate joins and language identification.

Nothing else in the library imports this package; ``queries`` holds the registered
queries (``QUERIES``) and their DuckDB statements (``ORACLE``).
"""

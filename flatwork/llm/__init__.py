"""Operators of a training-data pipeline: deduplication, search, token output, packing, PII, language.

Nothing else in the library imports this package. Text is never cut to a prefix, and a null text
counts as empty unless an operator says otherwise.
"""

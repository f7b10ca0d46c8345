"""Operators of a training-data pipeline: quality, duplicates, mixing, packing, archives, search.

Nothing else in the library imports this package; ``larder.llm.queries`` names its queries.
"""

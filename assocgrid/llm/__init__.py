"""Operators of a training-data pipeline: text, token and vector tables at corpus size.

Nothing else in the library imports this package; ``llm.queries`` lists its registered queries.
"""

"""Sequence mapping over DataFrames, and (in ``llm``) corpus preparation."""

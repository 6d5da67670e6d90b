"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this package; its queries are listed in
``lodestone.llm.queries``.
"""

"""Operators for training data: counting, searching, classifying, filtering, deduplicating, packing and formatting.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""

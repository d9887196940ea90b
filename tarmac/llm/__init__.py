"""Training-data operators: one module per operator, ``catalog`` registers their queries.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""

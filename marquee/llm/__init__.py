"""Operators for preparing training text at scale.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports
from here; the entry file adds these queries only when the folder exists.
"""

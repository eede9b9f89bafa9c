"""Operators for preparing training text: filters, joins, mixing, tokens, chat and search.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""

"""Operators for preparing language-model training data.

Nothing outside this folder imports it; ``llm.queries`` registers one query per
operator and ``__spark_entry__`` adds them when the folder is present.
"""

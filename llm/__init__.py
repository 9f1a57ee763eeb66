"""Operators for building training corpora.

Nothing outside this folder imports it; ``__spark_entry__`` registers its
queries only when it can be imported.
"""

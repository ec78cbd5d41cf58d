"""Operators that prepare text and vectors for language-model training.

Nothing outside this package imports it; the entry module adds its queries if it is there.
"""

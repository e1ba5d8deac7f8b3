"""Operators for building text corpora for language-model training.

Nothing outside this folder imports it.  ``queries.py`` holds the registered queries.
"""

"""Operators for preparing text corpora for language-model training.

Nothing outside this folder imports it. Each module holds one operator with a
general interface; ``queries`` binds them to the test tables.
"""

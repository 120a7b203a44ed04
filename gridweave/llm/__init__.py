"""Operators for preparing large text and media corpora.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and their SQL.
"""

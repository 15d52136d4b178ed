"""Operators for preparing text corpora for model training, as Spark jobs.

Nothing outside this subpackage imports it.  ``queries.py`` holds the registered queries and their SQL.
"""

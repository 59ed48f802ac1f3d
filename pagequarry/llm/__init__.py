"""Operators for building training corpora.

Nothing else in the library imports this subpackage.  ``queries.queries()`` and
``queries.oracle_sql()`` hold its registered queries.
"""

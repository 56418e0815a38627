"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it.  The registered queries and their
SQL are in :mod:`barloom.llm.queries`.
"""

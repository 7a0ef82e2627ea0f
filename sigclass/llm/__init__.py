"""Operators for preparing large text corpora, their registered queries and SQL.

Nothing else in the library imports this subpackage.
"""

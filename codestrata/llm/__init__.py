"""Operators of a training-data pipeline and the queries that apply them.

Nothing outside this subpackage imports it. Each operator is a module with its own
interface. ``queries`` names the production runs over whole tables.
"""

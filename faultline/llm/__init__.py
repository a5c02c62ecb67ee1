"""Operators of a training-data pipeline over a ``documents`` table.

Every module holds one operator with its own general interface; ``queries`` has
the thin ``opN_<name>`` queries that apply them to the whole tables.
"""

"""Operators for preparing training text.

Nothing else in ``lodestar`` imports this subpackage. Each module holds one
operator with its own general interface; :mod:`lodestar.llm.registry` turns
them into registered queries.
"""

"""Registered queries: each applies one operator, with production parameters, to a whole table."""

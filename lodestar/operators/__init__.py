"""Operators: DataFrame in, DataFrame out. ``by`` are key columns, ``order`` the order columns."""

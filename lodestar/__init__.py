"""Analytics operators for ordered and irregular data, as Spark DataFrame operations."""

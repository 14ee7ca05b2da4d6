"""Registered queries, each with the SQL it equals where SQL can say it."""

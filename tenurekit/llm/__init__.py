"""Operators for preparing training data, their queries and the SQL that checks them. Nothing else in the library imports this."""

"""Queries over the driver's ``events`` table, and the SQL they must agree with."""

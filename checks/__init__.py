"""Registered queries with the SQL each one is checked against, grouped like the operators they exercise."""

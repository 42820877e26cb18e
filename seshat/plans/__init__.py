"""Queries on the driver tables, with their SQL."""

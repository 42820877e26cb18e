"""Operators on record tables: normalization, search, profiles, ledgers."""

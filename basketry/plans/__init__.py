"""Registered queries (``queries()`` keys) and their DuckDB oracle SQL."""

"""Fixtures over the driver tables, the named query catalog with DuckDB oracles, and check tools."""

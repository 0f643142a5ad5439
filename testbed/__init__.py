"""Test tables, registered queries and their DuckDB counterparts."""

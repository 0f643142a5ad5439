"""Relational building blocks: filters, look-ups, as-of join, baselines."""

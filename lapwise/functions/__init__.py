"""Column expressions and mergeable statistics."""

"""Stint, tyre-wear and lap-time analytics as Spark DataFrame jobs."""

"""Composed jobs, the query catalogue and its test-data adapters."""

"""Hybrid ranking, retrieval and corpus preparation as plain Spark plans."""

"""Compositions of operators: the read tools, and ingestion."""

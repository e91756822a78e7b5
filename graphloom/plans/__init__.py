"""Compositions of operators: routing, playbooks, hybrid search, incremental ingestion."""

"""Structured Streaming forms of the operators on event logs, and their batch forms."""

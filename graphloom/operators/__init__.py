"""Relational operators over nodes, edges, vectors, files, jobs and logs."""

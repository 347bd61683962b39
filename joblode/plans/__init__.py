"""Compositions: the ingest run and the question tools."""

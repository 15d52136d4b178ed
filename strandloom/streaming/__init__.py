"""Streaming forms of the mapping jobs."""

"""Structured Streaming forms of the batch jobs, with the same output columns."""

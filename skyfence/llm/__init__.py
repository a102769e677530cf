"""Operators for building training corpora, and the queries that run them over the given tables."""

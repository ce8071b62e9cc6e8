"""Readers and writers for review tables, reports, embeddings and feature sets."""

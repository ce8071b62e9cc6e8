"""Batch and streaming scoring of reviews."""

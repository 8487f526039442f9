"""Readers of the documents that cost records come in."""

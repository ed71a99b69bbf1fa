"""Structured Streaming forms of the board, dedup and reservation operators."""

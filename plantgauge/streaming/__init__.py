"""Structured Streaming forms of the windowing and alert operators."""

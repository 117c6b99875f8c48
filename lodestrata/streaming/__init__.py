"""Incremental and Structured Streaming operators."""

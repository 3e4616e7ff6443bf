"""Structured Streaming jobs, each with a batch twin on the same columns."""

"""Incremental upkeep: batch and Structured Streaming."""

"""Readers of exports and session logs, the provider table, and sinks."""

"""Streaming forms of the event operators: additions of this engine, with watermarks for late events."""

"""Structured Streaming forms of the operators (same DataFrame functions)."""

"""Structured Streaming operators and job helpers."""

"""Edges the data leaves at."""

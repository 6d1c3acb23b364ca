"""Edges the data comes in at."""

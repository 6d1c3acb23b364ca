"""The applications: sources, operators and sinks put together."""

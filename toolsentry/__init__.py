"""Audit analytics for agent-tool servers and packages on Spark DataFrames and streams."""

__version__ = "0.1.0"

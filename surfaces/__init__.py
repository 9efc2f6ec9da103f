"""Queries over the provided tables, and the same results in DuckDB SQL."""

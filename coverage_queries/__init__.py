"""Registered queries and the DuckDB SQL they are checked against, by topic."""

"""Registered queries of the engine, with their DuckDB oracles."""

"""Cypher text to lazy DataFrames."""

"""Operators over the record graph: each takes and returns DataFrames and writes nothing."""

"""Structured Streaming over the log and over events."""

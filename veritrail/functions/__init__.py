"""Column expressions: instants, canonical JSON, text keys and similarities."""

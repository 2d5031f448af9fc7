"""Column expressions: event time, windows, keys and tokens."""

"""Column expressions: geometry, time, classification and text."""

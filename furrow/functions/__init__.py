"""Column expressions: colour, geometry, highlight, time."""

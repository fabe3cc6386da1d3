"""Column expressions: ids, standings, geometry, runs, text."""

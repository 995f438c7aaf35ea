"""Column expressions: names, parsing and scoring. All run inside Spark's own expressions."""

"""Column expressions: parsing, rounding, names, classes, dates."""

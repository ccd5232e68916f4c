"""Column expressions: everything here takes columns and returns a column."""

"""Column functions: each takes Columns (or names) and returns a Column."""

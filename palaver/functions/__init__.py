"""Column functions: Column to Column, all built-in expressions."""

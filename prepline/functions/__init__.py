"""Column functions: safe arithmetic, numeric, text and special functions."""

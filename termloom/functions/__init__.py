"""Column functions: text to words, and the weighting formulas."""

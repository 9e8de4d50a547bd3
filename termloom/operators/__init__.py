"""Counting, weighting, ranking and replacing, as DataFrame transformations."""

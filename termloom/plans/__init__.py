"""Whole jobs, from documents to ranked tags."""

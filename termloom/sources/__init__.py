"""Where corpora are read from and results are written to."""

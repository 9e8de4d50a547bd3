"""termloom: term weighting of text corpora as plain Spark jobs."""

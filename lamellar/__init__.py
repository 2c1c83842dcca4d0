"""Column-group tables and large-corpus operators on Spark."""

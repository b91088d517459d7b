"""Sources: canonical views over the given tables, and stream readers."""

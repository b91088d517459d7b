"""Reusable relational operators: joins, rankings, percentiles, runs, rollups, merges."""

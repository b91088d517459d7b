"""Analytics and data maintenance for priced, capacity-limited block data on Spark."""

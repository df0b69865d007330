"""tablelens: what a table holds, and aggregate questions about it, on Spark."""

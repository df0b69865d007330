"""Reading, writing and listing tables."""

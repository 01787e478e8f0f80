"""Reading, writing and derived tables."""

"""Graph, join and aggregation operators over the stored tables."""

"""Training-data operators: scoring, search, mixing, counting, deduplication, filtering."""

"""Training-data operators: sharding, scoring, search, deduplication, packing."""

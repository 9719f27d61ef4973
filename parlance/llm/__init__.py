"""Training-data operators: deduplication, filtering, mixing, formatting, sharding."""

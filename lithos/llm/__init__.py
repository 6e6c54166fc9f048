"""Training-data operators: deduplication, tokenising, scoring, search, mixing, sharding and storage."""

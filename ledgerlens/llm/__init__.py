"""Training-data operators: tokenising, deduplication, decontamination, sharding, filtering, extraction."""

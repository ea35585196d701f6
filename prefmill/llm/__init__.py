"""Training-data operators: mixing, filtering, extraction, deduplication."""

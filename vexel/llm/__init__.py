"""Training-data operators: search, deduplication, filtering, scoring and packing of text."""

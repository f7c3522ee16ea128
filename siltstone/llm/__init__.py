"""Training-data operators: deduplication, filtering, mixing, packing, encoding and search."""

"""Training-data operators: text quality, deduplication, packing, mixing and output."""

"""Training-data operators: media columns, packing, tokenising, deduplication, scoring."""

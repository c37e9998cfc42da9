"""Training-data operators: deduplication, mixing, packing, classifiers and vector search."""

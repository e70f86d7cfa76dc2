"""Training-data operators: deduplication, tokens, packing, search and document classifiers."""

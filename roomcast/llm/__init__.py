"""Training-data operators: filters, tokenizing, deduplication, sampling, search, formatting."""

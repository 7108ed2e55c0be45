"""Training-data operators: deduplication, language and quality models, tokenizing, mixing, search."""

"""Training-data operators: extraction, deduplication, tokens, packing, quality, shards."""

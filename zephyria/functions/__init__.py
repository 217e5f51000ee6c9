"""Pure Column functions; identical in batch and streaming plans."""

"""Training-data operators: tokens, extraction, fingerprints, quality, packing, duplicates, secrets, leaks, language."""

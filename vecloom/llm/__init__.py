"""Training-data operators: token counts, language, quality, dedup, LM scores, mixing, fingerprints."""

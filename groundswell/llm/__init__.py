"""Training-data operators: packing, quality, near and exact duplicates, fingerprints, mixing, scoring, PII, language."""

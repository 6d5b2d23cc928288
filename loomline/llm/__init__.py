"""Training-data operators: near-duplicates, language, tokens, shards, mixing, PII, quality, stores, decontamination."""

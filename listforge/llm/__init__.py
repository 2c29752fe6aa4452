"""Training-data operators: mixing, dedup, quality, sharding, search, URLs, PII, BPE."""

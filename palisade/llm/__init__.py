"""Training-data operators: quality, deduplication, media, sharding, tokens, rules, PII, licences, mixing."""

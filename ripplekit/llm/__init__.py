"""Training-data operators: quality, language, scoring, search, packing, sharding, dedup."""

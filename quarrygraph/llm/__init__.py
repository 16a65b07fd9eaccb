"""Training-data operators: scoring, deduplication, packing, media, mixing, search, sharding, archives."""

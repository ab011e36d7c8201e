"""Training-data operators: scoring, mixing, formatting, dedup, packing, counting, scanning, search, filtering."""

"""Training-data operators: dedup, scoring, tokenising, search, extraction, mixing, filtering."""

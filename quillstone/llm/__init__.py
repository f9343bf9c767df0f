"""Training-data operators: dedup, extraction, tokenising, decontamination, filtering and archives."""

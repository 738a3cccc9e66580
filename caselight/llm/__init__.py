"""Training-data operators: secret scans, toxicity, extraction, near and exact repeats, encoding, quality, search, decontamination."""

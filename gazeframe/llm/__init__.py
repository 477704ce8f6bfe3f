"""Training-data operators: URL filter, toxicity, near-duplicates, WARC, packing, decontamination, token files, secrets, HTML text."""

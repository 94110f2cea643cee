"""Training-data operators: quality, near duplicates, secrets, language, tokens, extraction, decontamination."""

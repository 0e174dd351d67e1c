"""Training-data operators: deduplication, search, mixing, redaction, scoring and tokenizing at corpus scale."""

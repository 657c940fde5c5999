"""Training-data operators: deduplication, quality, toxicity, language, URL and
licence filters, source mixing and tokenization for very large corpora."""

"""Training-data operators: filtering, deduplication, tokenisation, packing and scoring of text corpora."""

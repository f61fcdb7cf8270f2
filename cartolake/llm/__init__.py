"""Training-data operators: filtering, deduplication, tokenisation, packing and classification of text corpora."""

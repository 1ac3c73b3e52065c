"""Operators for large text corpora: cleaning, deduplication, decontamination, encoding, scoring."""

"""Operators for building training corpora: deduplication, decontamination, scoring, formatting and tokens."""

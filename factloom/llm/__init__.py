"""Operators for training corpora: cleaning, deduplication, scoring, mixing and encoding."""

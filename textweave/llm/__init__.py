"""Operators for training corpora: extraction, deduplication, filtering, mixing, packing."""

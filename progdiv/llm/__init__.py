"""Operators for building training corpora: deduplication, scanning, scoring, mixing and packing."""

"""Operators for building training corpora: selection, de-duplication, scoring, search and packing."""

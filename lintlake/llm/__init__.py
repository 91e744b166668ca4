"""Operators for building training corpora: near-duplicates, packing, extraction, mixing, quality and toxicity."""

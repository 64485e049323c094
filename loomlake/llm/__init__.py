"""Operators for training data: sampling, overlap, splitting, tokenising, packing, cleaning."""

"""Operators for training data: encodings, duplicates, term frequencies, look-alikes, packing, mixing and spam."""

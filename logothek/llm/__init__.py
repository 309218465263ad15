"""Operators for training data: consistent text, survivors, overlaps, encoding, mixing and quality."""

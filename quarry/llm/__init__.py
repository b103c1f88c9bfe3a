"""Operators for building training data from the records: matching, cleaning, encoding, mixing."""

"""Operators for training data: near duplicates, splitting, credentials, packing, mixing, stuffing."""

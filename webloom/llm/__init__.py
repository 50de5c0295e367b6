"""Operators of a training-data pipeline: formatting, tokens, packing, fingerprints, duplicates, quality, URLs."""

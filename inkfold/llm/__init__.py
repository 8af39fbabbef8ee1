"""Operators of a training-data pipeline: packing, secrets, tokens, quality, fingerprints and duplicates."""

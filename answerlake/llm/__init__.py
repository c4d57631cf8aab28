"""Operators for training-data pipelines: quality, privacy, duplicates, licenses, leaks, language, mixing, archives."""

"""Operators for training-data pipelines: deduplication, tokens, language, quality, secrets, decontamination."""

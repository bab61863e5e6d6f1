"""Operators for training-data pipelines: language, toxicity, deduplication, decontamination, scoring, extraction, tokens."""

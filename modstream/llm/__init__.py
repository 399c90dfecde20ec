"""Operators of a training-data pipeline: mixing, tokenizing, scans, filters and near-duplicate search."""

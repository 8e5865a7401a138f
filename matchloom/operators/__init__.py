"""Operators of record linkage: blocking, features, metrics, sampling, validation."""

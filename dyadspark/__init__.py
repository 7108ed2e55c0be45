"""Spark jobs that build and analyse turn-pair datasets from two-person conversations."""

"""Operators of a training-data pipeline: filtering, near-duplicates, decontamination, mixing, archives and scoring."""

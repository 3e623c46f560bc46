"""Micro-batch application of deltas to the snapshot tables."""

"""Preparation of training data: splitting, statistics, de-duplication, ranking, packing, leakage, privacy.

Nothing else in the package imports this subpackage; it may use the core.
"""

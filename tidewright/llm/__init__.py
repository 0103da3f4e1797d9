"""Operators for large text corpora: deduplication, decontamination, quality, packing.

Nothing else in the package imports this one.
"""

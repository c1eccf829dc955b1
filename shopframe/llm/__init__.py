"""Operators of a training-data pipeline: quality, deduplication,
decontamination, safety scans, formatting, archives and packing.

Nothing else in the library imports this subpackage.
"""

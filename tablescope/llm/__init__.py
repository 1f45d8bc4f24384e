"""Operators for preparing training data at scale: near-duplicates, mixing, scans, archives, token files, packing and quality rules."""

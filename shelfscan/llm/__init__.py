"""Operators for preparing text corpora: scoring, deduplication, masking, extraction, packing, archives."""

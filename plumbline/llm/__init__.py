"""Operators for preparing large text collections: filtering, deduplication, extraction, packing and search."""

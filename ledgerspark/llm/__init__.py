"""Operators for preparing text corpora: tokenising, deduplication, sharding, extraction, scoring, filtering."""

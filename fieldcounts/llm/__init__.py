"""Operators of a training-data pipeline: filtering, deduplication, masking, packing, tokenising, archiving."""

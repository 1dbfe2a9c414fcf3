"""Commitment-state analytics on Spark: versions, amendments, lineage, gates and evaluation."""

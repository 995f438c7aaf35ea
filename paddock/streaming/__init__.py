"""Incremental ingestion as micro-batches."""

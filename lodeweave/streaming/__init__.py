"""Incremental maintenance, in batches and streams."""

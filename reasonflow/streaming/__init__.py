"""Incremental processing of record files as they arrive."""

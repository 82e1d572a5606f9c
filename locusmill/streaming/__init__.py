"""Incremental ingest of contact pairs."""

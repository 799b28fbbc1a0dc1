"""Incremental ingest, an extension: the operators themselves are batch."""

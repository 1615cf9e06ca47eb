"""Readers, ingest jobs and sinks."""

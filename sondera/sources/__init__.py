"""Readers, page ingest, generators and writers."""

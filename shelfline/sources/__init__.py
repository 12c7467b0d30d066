"""Readers and writers: snapshots, catalog documents, file systems, logs."""

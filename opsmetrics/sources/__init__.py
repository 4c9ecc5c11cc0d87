"""Readers and parsers of monitor captures, logs, snapshots and catalogs."""

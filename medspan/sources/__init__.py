"""Readers and writers: terminology release files, index tables, notes and results."""

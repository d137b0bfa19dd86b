"""Structured Streaming: annotation of a stream of notes."""

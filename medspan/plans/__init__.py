"""Whole plans: annotation of notes, and the queries of the driver contract."""

"""Readers and writers: source tables, extracts, reflection log, completion snapshots."""

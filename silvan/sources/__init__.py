"""Readers of raw corpora into parsed units, and the projection files."""

"""Resumable runs: parsed units arrive as files and are taken in once."""

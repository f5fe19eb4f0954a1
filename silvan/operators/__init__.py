"""Operators on the unit tree, the taxonomy, spans, vectors, audits and projections."""

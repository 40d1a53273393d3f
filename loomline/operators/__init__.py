"""Relational operators of a comparison: matching, conflicts, unification, resolution, metrics."""

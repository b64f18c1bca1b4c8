"""Column functions: seeded keys, projections, text and array helpers."""

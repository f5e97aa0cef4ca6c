"""Column functions: interval relations, geometry, motion types, text."""

"""Lattice: DataFrame jobs over versioned dependency graphs."""

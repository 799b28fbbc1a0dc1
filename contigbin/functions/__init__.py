"""Column functions: DNA strings, vectors and distributions, all built from native expressions."""

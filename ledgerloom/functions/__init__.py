"""Column-level functions and the fixed vocabularies."""

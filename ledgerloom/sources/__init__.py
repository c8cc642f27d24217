"""Feed contracts, readers, writers and the projections of the test tables."""

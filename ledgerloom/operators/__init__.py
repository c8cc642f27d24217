"""DataFrame-to-DataFrame operators, one module per pipeline stage."""

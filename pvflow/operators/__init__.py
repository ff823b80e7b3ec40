"""DataFrame -> DataFrame operators, one module per family."""

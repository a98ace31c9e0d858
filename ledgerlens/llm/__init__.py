"""Training-data operators: one module for each operator, plus their queries."""

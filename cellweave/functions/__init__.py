"""Column helpers and order statistics that the operators are built from."""

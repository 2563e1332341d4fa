"""Column helpers: time arithmetic and small expressions."""

"""Column functions: text, search terms and vectors."""

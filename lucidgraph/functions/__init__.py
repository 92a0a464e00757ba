"""Column functions: terms, rule measures, vectors."""

"""Column expressions: identifiers, text, paths and secrets."""

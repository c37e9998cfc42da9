"""Column expressions: text, code and prose tests, identifiers, paths, questions, vectors."""

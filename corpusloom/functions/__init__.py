"""Column expressions: paths, globs, languages, file rules, header extraction."""

"""Column builders: JSON checks, argument dialects, tag readers, normaliser and format check."""

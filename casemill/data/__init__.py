"""Fixed values kept as files."""

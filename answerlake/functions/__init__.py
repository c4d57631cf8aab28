"""Column-level functions (text, payload JSON, patterns)."""

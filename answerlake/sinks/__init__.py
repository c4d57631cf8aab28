"""Sinks: logs, CSV rewrites, index files, appends."""

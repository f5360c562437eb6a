"""Readers of logs, events, maps and models, and the matching writers."""

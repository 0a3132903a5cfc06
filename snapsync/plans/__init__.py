"""Decisions about what to copy."""

"""Millrace: sources."""

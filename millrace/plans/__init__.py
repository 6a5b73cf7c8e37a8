"""Millrace: plans."""

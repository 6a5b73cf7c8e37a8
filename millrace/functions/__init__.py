"""Millrace: functions."""

"""Millrace: a Spark-first analytics engine (see README.md)."""

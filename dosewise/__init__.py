"""Repeated-measures analytics as plain Spark plans."""

"""Matched factorial experiments and probe analytics as Spark DataFrame jobs."""

"""Mood-space and sequence analytics as Spark DataFrame operators."""

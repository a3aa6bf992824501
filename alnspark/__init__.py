"""Sequence-alignment analytics on Spark."""

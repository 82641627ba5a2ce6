"""Bout-history analytics on Spark."""

"""Fingerprint search and evaluation on Spark."""

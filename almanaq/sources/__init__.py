"""Scans, lookups and saved tables."""

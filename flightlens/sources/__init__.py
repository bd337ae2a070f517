"""Scans, sinks and catalog tables."""

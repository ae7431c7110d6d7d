"""Scans, parameter-stamped cache tables and sinks."""

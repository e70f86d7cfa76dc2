"""Scans, canonical sheets, guards and sinks."""

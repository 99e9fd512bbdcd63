"""Schemas, scans, stand-in views over the driver tables, and sinks."""

"""Scans (scans.py, archives.py), sinks (sinks.py) and the file store they share (store.py)."""

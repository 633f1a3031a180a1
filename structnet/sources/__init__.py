"""Scans of manifests, structure files and lookup files, and the sinks."""

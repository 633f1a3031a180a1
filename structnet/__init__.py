"""Spatial interaction networks of macromolecular structures, as Spark jobs."""

"""Scans: dataset registry, JSON datasets, benchmark tables, dialogue turns."""

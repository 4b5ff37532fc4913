"""Instruction-data preparation and code-completion scoring as Spark jobs."""

__version__ = "0.1.0"

"""Spark jobs for the data work around text-embedding models."""

__version__ = "0.1.0"

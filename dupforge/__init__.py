"""Duplicate resolution over catalogues of files and records, on Spark."""

__version__ = "0.1.0"

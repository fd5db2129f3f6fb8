"""Siftwell: document search and corpus hygiene on PySpark."""

__version__ = "0.1.0"

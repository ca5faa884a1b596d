"""Voxmill: voice-of-customer analytics expressed as PySpark plans."""

__version__ = "0.1.0"

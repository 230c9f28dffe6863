"""Tesserine: DataFrame-first analytics over document corpora and concept graphs."""

__version__ = "0.1.0"

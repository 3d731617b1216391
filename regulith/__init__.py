"""Corpus analytics for regulation-style documents, written for Apache Spark."""

__version__ = "0.1.0"

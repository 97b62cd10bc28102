"""Spark-native engine for document structure: layout rows in, chapters and Markdown out."""

__version__ = "0.1.0"

"""Spark jobs for large tables of dated items with text and numeric features."""

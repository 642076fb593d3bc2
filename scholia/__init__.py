"""Scholia: document-corpus analytics as plain PySpark jobs."""

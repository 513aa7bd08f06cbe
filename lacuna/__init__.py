"""Spark jobs that find, redact and restore sensitive data in tables of documents."""

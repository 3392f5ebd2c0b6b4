"""Tessella: document-corpus analytics as Spark jobs."""

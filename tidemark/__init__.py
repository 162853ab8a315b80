"""Tidemark: file-metadata hygiene and corpus preparation as Spark jobs."""

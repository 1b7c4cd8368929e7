"""Tidemark: stream-experiment analytics and corpus preparation as Spark jobs."""

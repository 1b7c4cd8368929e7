"""Stateful and incremental jobs over streams."""

"""Strict readers and sealed writers."""

"""Readers and writers at the boundary."""

"""Scalar building blocks: paths, patterns, text."""
